"""Feed validation, reconciliation and operations analytics on Spark DataFrames."""
