"""Governed file ingest and data quality on Spark."""
