"""PySpark-native code-graph analytics."""
