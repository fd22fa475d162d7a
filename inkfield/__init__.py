"""inkfield: a PySpark-native engine that turns recognised text blocks into validated records."""
