"""A PySpark-native engine that measures how faithfully code is edited."""
