"""Whole analyses built from the operators. Each returns lazy DataFrames by table name."""
