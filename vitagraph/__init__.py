"""Evidence knowledge graphs on Spark DataFrames."""
