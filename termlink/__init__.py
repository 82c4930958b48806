"""PySpark-native linking of dictionary terms to short labels."""
