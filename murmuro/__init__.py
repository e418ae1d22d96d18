"""murmuro: a Spark-native engine for collecting, cleaning, modelling and compressing short messages."""
