"""foliant: page-text analytics on PySpark DataFrames."""
