"""Spark-first component-selection catalog: ingest, match, merge, score, validate, query."""
