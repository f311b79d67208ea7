"""Operators for preparing large text corpora for model training.

Nothing else in the library imports this package. Every operator takes and
returns DataFrames; the registered queries are thin and live in ``queries``.
"""
