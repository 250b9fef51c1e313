"""Operators on text for training data.

Nothing outside this subpackage imports it.  ``queries.QUERIES`` and
``queries.ORACLE_SQL`` are picked up by ``__spark_entry__`` when the subpackage
is importable.
"""
