"""quarrymill: a Spark-first engine that turns document collections into chunk corpora and knowledge graphs."""

__version__ = "0.1.0"
