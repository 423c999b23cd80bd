"""Operators of the anomaly analytics."""
