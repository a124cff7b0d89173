"""chronomill: code-history metrics and analytics on Spark DataFrames."""
