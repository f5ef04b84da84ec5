"""Lake catalogue, profiling and relationship engine on Spark DataFrames."""
