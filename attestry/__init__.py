"""A PySpark-native evidence engine for chat exports, their review and the documents written from them."""
