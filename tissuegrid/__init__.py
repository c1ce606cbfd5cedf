"""Cell-level spatial expression analytics on PySpark DataFrames."""
