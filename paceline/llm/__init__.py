"""Operators for preparing large text corpora on Spark.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general DataFrame interface; ``queries.py`` binds them to the test tables.
"""
