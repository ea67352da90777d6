"""Operators for preparing training text: ten distributed corpus operators and their queries.

Nothing outside this package imports it; `__spark_entry__` adds its queries when it is there.
"""
