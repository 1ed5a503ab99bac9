"""Customer-journey analytics on Spark: DataFrame in, DataFrame out."""
