"""Operators: plain ``DataFrame -> DataFrame`` functions with keys and columns as parameters."""
