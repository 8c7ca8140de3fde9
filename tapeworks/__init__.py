"""Technical analysis of OHLCV series, and operators of a training-data pipeline, on Spark DataFrames."""
