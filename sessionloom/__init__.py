"""Session decision analytics as Spark DataFrame and Structured Streaming jobs."""

__version__ = "0.1.0"
