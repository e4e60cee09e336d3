"""Operators that prepare training text: one module per operator.

Nothing outside this subpackage imports it.  ``catalog`` holds the queries
and the SQL that ``__spark_entry__`` registers when the subpackage is there.
"""
