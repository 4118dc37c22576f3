"""A PySpark-native engine for layered pages of printed scholarly editions."""
