"""A photo-culling analytics engine on Spark DataFrames."""
