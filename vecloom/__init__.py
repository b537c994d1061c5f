"""vecloom: exact semantic retrieval, index maintenance and corpus processing on Spark."""

__version__ = "0.1.0"
