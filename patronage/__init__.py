"""Customer analytics over retail transactions, built on Spark DataFrames."""
