"""Analysis of software structure on Spark DataFrames."""
