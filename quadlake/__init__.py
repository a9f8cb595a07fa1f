"""quadlake: structured-matrix analytics expressed as Spark DataFrames."""
