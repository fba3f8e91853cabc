"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage; remove the folder and the
rest still works.  Every operator takes DataFrames and column names and returns
a DataFrame; the queries that apply them to whole tables are in ``registry``.
"""
