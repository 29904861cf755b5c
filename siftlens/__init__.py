"""siftlens: a Spark-first engine that reads structured content out of files and queries it as tables."""

__version__ = "0.1.0"
