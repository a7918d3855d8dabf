"""A PySpark-native engine for versioned, ordered key-value data."""
