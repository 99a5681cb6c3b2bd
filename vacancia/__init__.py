"""Analytics over job postings, expressed as PySpark DataFrames."""
