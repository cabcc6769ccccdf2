"""Operators for preparing large text corpora.

Nothing else in the library imports this subpackage; it can be removed as a
whole.  Every operator takes and returns DataFrames and is safe to re-run on a
cluster that loses executors: intermediate results that are read more than once
are written to the folder named by ``spark.checkpoint.dir``.
"""
