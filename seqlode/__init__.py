"""Token-sequence retrieval, statistics and evaluation on Spark DataFrames."""
