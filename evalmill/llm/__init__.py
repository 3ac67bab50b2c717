"""Operators of a training-data pipeline on Spark DataFrames.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames, distributes its work by Spark's own joins, groupings and
partitions, and keeps intermediate tables in the shared folder that the session
names in ``spark.checkpoint.dir`` (see :mod:`evalmill.llm.shared`).
"""
