"""Weather observation, storm-track and radar-grid analytics on Spark DataFrames."""
