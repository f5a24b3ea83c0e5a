"""Recommendation and vector analytics as Spark DataFrame jobs."""
