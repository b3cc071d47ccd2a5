"""Spark-first analytics for depth frames, regions and tracks."""
