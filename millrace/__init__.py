"""millrace: a warehouse analytics engine on PySpark DataFrames."""
