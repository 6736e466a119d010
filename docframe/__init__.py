"""docframe: documents, tables, text, vectors, time series and versions as Spark DataFrames."""
