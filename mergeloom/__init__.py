"""A Spark-native engine that merges two independently designed tables."""
