"""Market-data and trading-research operators on Spark DataFrames."""
