"""dowser: a PySpark-native engine that indexes and searches document collections."""
