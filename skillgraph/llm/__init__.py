"""Operators for preparing training text, each a Spark job of its own.

Nothing outside this subpackage imports it. ``queries.py`` holds the
registered queries and ``oracles.py`` their SQL.
"""
