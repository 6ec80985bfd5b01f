"""Leafmill: document retrieval analytics and training-data operators on Spark DataFrames."""
