"""A PySpark engine for text retrieval and corpus work on DataFrames."""
