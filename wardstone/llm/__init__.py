"""Training-data operators: dedup, packing, scoring, extraction and filtering of text corpora.

Nothing outside this package imports it. Operators take and return DataFrames; intermediate tables that a later
stage reads twice are written below ``spark.checkpoint.dir``.
"""
