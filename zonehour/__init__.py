"""A PySpark-native engine for origin-destination demand analytics."""
