"""Energy analytics for mobile radio cells, as PySpark DataFrame operations."""
