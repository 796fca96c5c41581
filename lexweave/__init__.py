"""lexweave: set-at-a-time text retrieval analytics on Spark DataFrames."""
