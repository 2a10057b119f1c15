"""Spark-first analytics: composite scoring, resolution, relations, geometry, ranking and placement."""
