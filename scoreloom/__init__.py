"""Scoring, comparison and audit of archived model answers as Spark jobs."""
