"""Behavioural transaction-risk analytics expressed as Spark jobs."""
