"""PySpark-native analytics for multi-perspective news coverage."""
