"""Operators for large text corpora used to train language models.

Each module holds one operator; ``queries`` registers one query per operator and
``sql`` their DuckDB counterparts where SQL can express them.  Nothing outside
this subpackage imports it.
"""
