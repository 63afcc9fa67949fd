"""Spark-first operators for corpora, search, records, memory and rules."""
