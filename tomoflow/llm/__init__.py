"""Operators for large training-data pipelines, one module per operator.

Nothing outside this subpackage imports it.  ``registry`` lists the thin
queries that apply each operator to its whole table, with the SQL that
expresses them where SQL can.
"""
