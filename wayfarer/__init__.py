"""Places analytics on Spark: DataFrame operators over points of interest."""
