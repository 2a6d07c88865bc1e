"""weblens: a PySpark-native engine for web-content data."""
