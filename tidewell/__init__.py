"""tidewell: a Spark-native incremental analytics engine."""
