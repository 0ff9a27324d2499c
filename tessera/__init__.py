"""A PySpark-native analytics engine for text-to-SQL training data."""
