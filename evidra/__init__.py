"""evidra: a Spark-native engine for retrieval, evidence assembly and answer evaluation."""

__version__ = "0.1.0"
