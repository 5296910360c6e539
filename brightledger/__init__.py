"""A Spark-native engine for disclosed financial data."""
