"""brightloom: a Spark-native engine for spoken-language-understanding corpora."""

__version__ = "0.1.0"
