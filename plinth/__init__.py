"""Analytics for business-intelligence sheets on Spark DataFrames."""
