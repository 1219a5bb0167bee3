"""Corpus audit and model comparison as plain Spark DataFrame operators."""
