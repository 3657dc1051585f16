"""pixelloom: PNG and animated-PNG analytics, decoding and encoding as Spark DataFrames."""
