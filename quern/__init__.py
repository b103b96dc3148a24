"""A small relational engine on PySpark DataFrames."""
