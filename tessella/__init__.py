"""tessella: a Spark-native engine for human-in-the-loop recognition data."""
