"""sediment: multi-version, ordered key-value data as Spark DataFrames."""
