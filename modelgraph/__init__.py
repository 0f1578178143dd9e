"""PySpark-native engine for declarative, statically typed data transformations."""
