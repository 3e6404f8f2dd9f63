"""A PySpark-native engine for typed concept graphs."""
