"""Read-depth and copy-number analytics on Spark: DataFrame in, DataFrame out."""
