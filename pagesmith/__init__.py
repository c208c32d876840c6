"""pagesmith: analytics over page-structured documents, on Spark DataFrames."""
