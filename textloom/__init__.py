"""textloom: prepare and search large tables of text with Spark DataFrames."""
