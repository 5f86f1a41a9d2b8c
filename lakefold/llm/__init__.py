"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it. Each module holds one operator;
`queries` holds the thin registered queries and their SQL.
"""
