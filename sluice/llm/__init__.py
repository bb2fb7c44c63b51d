"""Corpus operators for training-data pipelines, one module each.

Every operator takes DataFrames and column names and returns a DataFrame; the
registered queries in ``queries`` apply them to the tables of one folder.
"""
