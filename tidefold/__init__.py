"""An ordered key-value analytics engine on PySpark DataFrames."""
