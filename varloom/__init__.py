"""varloom: a PySpark-native engine for genome-wide association summary statistics."""
