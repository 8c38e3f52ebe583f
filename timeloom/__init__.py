"""Spark-first analytics over media timelines, capture telemetry and text corpora."""
