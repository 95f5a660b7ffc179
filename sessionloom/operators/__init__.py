"""Batch operators; most of them work on streaming DataFrames as well."""
