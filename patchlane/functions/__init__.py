"""Functions of the anomaly analytics."""
