"""lumenframe: still images as relations, on Spark DataFrames."""
