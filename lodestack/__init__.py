"""A PySpark-native catalogue and retrieval engine."""
