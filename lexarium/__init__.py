"""A PySpark-native engine for retrieval and analytics over document corpora."""
