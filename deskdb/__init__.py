"""A PySpark-native engine for desktop-database style data."""
