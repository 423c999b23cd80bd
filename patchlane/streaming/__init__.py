"""Streaming of the anomaly analytics."""
