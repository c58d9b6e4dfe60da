"""Scene analysis of ordered frame streams as Spark DataFrames."""
