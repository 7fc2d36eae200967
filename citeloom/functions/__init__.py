"""Spark-first building blocks; see README.md."""
