"""vigil: security and corpus analytics on Spark DataFrames."""
