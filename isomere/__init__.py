"""isomere: a Spark-native engine for stranded intervals and clustered reads."""
__version__ = "0.1.0"
