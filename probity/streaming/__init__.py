"""Structured Streaming forms of the monitoring and provenance operators."""
