"""Spark-first analytics for synchronized sensor streams and their text corpora."""
