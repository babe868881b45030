"""Operators for building training data sets at scale.

Nothing else in the library imports this subpackage; its queries are in
``queries.py`` and are added to the entry module only when it can be imported.
"""
