"""A PySpark-native engine for directory-listing metadata."""
