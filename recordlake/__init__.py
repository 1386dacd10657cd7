"""recordlake: a Spark-native engine for archives of semi-structured records."""
