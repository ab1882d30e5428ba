"""lociflow: population-genetic window statistics and track analytics as Spark DataFrames."""
