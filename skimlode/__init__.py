"""Block-skipping literal search over binary and text columns, on Spark DataFrames."""
