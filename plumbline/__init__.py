"""plumbline: a Spark-native engine that audits and prepares machine-learning datasets."""

__version__ = "0.1.0"
