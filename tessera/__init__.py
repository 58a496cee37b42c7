"""tessera: feed-to-canonical analytics and corpus preparation on Spark DataFrames."""
