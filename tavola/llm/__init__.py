"""Operators for large training-data pipelines.

One module per operator; ``queries`` registers one query per operator over
the whole test tables and ``oracle`` holds the SQL for those SQL can state.
Nothing outside this subpackage imports it.
"""
