"""Readers that yield field records, samplers and writers."""
