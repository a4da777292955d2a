"""Spark-first analytics and data-processing operators for messy multi-source listings."""
