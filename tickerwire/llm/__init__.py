"""Operators for large-scale text-corpus preparation.

One module per operator; ``queries`` registers one query per operator and
``oracle`` holds the DuckDB SQL of those that SQL can express. Nothing outside
this subpackage imports it.
"""
