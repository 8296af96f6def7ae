"""siltweave: a Spark-native engine for crawled web content."""

__version__ = "0.1.0"
