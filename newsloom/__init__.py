"""News curation operators for Spark DataFrames."""
