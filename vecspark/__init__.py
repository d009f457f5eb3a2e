"""A PySpark-native engine for semantic search and training-data preparation."""
