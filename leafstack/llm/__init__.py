"""Operators of a training-data pipeline.

Every operator is a DataFrame -> DataFrame function in a module of its own; `queries` holds the
registered `opN_<name>` queries.  Nothing else in the library imports this package.
"""
