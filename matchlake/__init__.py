"""Match-scouting analytics on Spark DataFrames."""
