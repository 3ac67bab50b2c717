"""Evaluation analytics on Spark: labelled items, judge answers and pairwise judgments as DataFrames."""
