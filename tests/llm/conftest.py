from __future__ import annotations

import os

import pytest


@pytest.fixture(scope="session")
def sf_dir():
    """Folder of the smallest test tables."""
    return os.path.join(os.environ.get("TESTDATA", "/root/testdata"), "sf0.001")
