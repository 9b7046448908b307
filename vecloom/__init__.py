"""Analytics over tables of embedding vectors, on Spark DataFrames."""
