"""Road-network analytics on PySpark."""
