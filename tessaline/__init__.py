"""Document-anomaly analytics on PySpark."""
