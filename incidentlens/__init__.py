"""Incident analytics on Spark: ingest, features, training, scoring, explanation and reports."""
