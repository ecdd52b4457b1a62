"""telar: a PySpark-native analytics engine for public text records and official statistics."""
