"""trackloom: a Spark-native engine for track, point and embedding tables."""
