"""Continuous ingestion of newly arrived tiles."""
