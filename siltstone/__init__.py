"""A Spark-native engine for lossless recompression of file collections, as DataFrame operations."""
