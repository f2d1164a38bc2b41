"""Operators for building training corpora, on plain Spark.

Nothing outside this package imports it. ``queries`` holds the queries that
``__spark_entry__.py`` adds when this package is present.
"""
