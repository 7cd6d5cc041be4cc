"""folioforge: a Spark-first engine for document corpora and ranked retrieval."""

__version__ = "0.1.0"
