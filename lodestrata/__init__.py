"""Spark-first analytics engine for document corpora, retrieval and training data."""

__version__ = "0.1.0"
