"""Training-data operators: ten corpus-preparation steps built on Spark DataFrames."""
