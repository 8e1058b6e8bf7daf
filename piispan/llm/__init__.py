"""Operators of a training-data pipeline (deduplication, packing, filters, formats).

Nothing outside this subpackage imports it; `__spark_entry__` adds its queries only
when it can be imported.
"""
