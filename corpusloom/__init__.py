"""PySpark-native text-corpus analytics."""
