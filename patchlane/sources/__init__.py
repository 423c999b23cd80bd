"""Sources of the anomaly analytics."""
