"""A PySpark-native engine for imaging-style hierarchical data."""
