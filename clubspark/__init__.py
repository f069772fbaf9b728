"""Sports-venue analytics expressed as Spark DataFrames."""
