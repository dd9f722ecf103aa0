"""Millrace: a Spark-first engine for event-stream and table analytics."""

__version__ = "0.1.0"
