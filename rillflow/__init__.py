"""A PySpark-native engine for batch and streaming dataflow analytics."""
