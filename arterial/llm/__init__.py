"""Operators for preparing training data at scale.

Nothing else in the package imports this subpackage.  Every operator takes
DataFrames and column names and returns a DataFrame; the thin ``op*`` queries
that apply them to the standard tables live in :mod:`arterial.llm.queries`.
"""
