"""Panel time-series analytics on Spark DataFrames: features, splits, models, metrics, drift."""
