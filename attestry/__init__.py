"""Integrity assurance of multi-contributor machine-learning pipelines on Spark."""
