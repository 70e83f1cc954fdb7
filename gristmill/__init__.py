"""gristmill: batch retrieval, grounding and corpus analytics on Spark DataFrames."""
