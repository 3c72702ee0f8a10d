"""A Spark-native engine for searching and analysing linked text notes."""
