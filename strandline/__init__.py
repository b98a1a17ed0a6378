"""strandline: SQL lineage and training-data operators as plain PySpark DataFrames."""

__version__ = "0.1.0"
