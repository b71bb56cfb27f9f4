"""quoin: analytics over spatial layouts, reconstructions and tables, on Spark DataFrames."""
