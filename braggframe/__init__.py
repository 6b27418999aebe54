"""A Spark-native engine for structural, crystallographic and text tables."""
