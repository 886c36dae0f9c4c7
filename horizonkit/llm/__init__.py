"""Training-data operators: scoring, deduplication, scans, packing, export.

Every operator takes DataFrames and column names, reads only those columns,
and gives each edge case (nulls, empty or very long texts, repeated rows,
empty tables, clashing column names) the result its docstring states.
"""
