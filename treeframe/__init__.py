"""A Spark-native engine for tree-structured documents."""
