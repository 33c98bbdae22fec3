from __future__ import annotations

import contextlib
import os
import sys
import uuid

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def make_session():
    from towline.session import build_session

    spark = build_session(
        "towline-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": 8,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()


@pytest.fixture
def counted_jobs(spark):
    """Context in which Spark jobs are counted: ``with counted_jobs() as jobs: ...; jobs()``."""

    @contextlib.contextmanager
    def count():
        context, group = spark.sparkContext, f"counted-{uuid.uuid4().hex}"
        context.setJobGroup(group, group)
        try:
            yield lambda: len(context.statusTracker().getJobIdsForGroup(group))
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)

    return count
