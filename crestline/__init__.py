"""crestline: dynamic-range analytics on sampled signals, expressed as Spark DataFrames."""
