"""A PySpark-native engine for property graphs and text corpora."""
