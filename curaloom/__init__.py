"""A Spark-native engine for curating instruction-to-code datasets and evaluating models."""
