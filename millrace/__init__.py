"""A Spark-native engine for language-model and multimodal training data."""

__version__ = "0.1.0"
