"""Operators for training-data corpora: scoring, extraction, tokenizing, deduplication, search.

Every operator takes and returns DataFrames. Columns it adds are named by the caller or listed in its
docstring; columns it does not know are carried along.
"""
