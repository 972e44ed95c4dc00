"""docloom: document preparation and retrieval on Spark DataFrames."""
