"""foliomill: web pages and text documents processed as Spark DataFrames."""

__version__ = "0.1.0"
