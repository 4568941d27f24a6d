"""A Spark-first engine for long regulatory documents: extraction, chunking, retrieval, evaluation, reports."""

__version__ = "0.2.0"
