"""Web access-log analytics on PySpark."""
