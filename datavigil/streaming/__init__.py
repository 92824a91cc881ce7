"""Structured Streaming forms of detection, intake and the scan life cycle."""
