"""Operators for large training-data pipelines.

Nothing outside this package imports it. ``registry.queries()`` and
``registry.oracle_sql()`` hold what the driver contract adds.
"""
