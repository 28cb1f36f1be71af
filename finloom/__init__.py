"""PySpark-native analytics for bank transactions, statements and documents."""
