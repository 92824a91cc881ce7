"""Sensitive-data discovery and governance as Spark DataFrame jobs."""
