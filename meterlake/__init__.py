"""A PySpark-native engine for utility-billing documents."""
