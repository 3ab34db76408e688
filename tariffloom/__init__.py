"""tariffloom: a PySpark-native engine for trade-compliance analytics."""
