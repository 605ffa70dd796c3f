"""Operators of a training-data pipeline over text and embedding tables.

Nothing else in the library imports this subpackage.
"""
