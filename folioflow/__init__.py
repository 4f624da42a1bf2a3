"""A Spark-native document dataflow engine."""
