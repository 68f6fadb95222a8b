"""Training-data operators: scoring, search, formatting, extraction, mixing, filtering and encoding.

Nothing outside this folder imports it.  Every operator reads ordinary DataFrames, keeps its work on the
executors, and cuts lineage only through tables in the shared folder named by ``spark.checkpoint.dir``.
"""
