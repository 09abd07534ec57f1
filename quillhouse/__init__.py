"""Transcript lakehouse on Spark: capture, interpretation, authorship, search, reading and governance as DataFrame jobs."""
