"""Event-marker, interval, window-feature and timeline analytics on Spark DataFrames."""
