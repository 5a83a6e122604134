"""textloom: corpus governance and evaluation operators on Spark DataFrames."""
