"""Analytics for irregular event streams on Spark: DataFrame-to-DataFrame operators."""
