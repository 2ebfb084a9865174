"""Analytics over partitioned event logs, and training-data operators, on Spark DataFrames."""
