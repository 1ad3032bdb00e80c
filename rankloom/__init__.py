"""Ranked retrieval, fusion and evaluation over conversational data, as Spark DataFrame operations."""
