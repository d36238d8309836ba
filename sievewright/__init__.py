"""A text-corpus curation engine on Spark DataFrames."""
