"""plumbline: a Spark-native text-integrity analytics engine."""

__version__ = "0.1.0"
