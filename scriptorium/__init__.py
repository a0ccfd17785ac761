"""scriptorium: a Spark-native engine for building, auditing and evaluating labelled text corpora."""

__version__ = "0.1.0"
