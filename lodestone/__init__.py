"""A PySpark-native evidence retrieval and corpus processing engine."""
