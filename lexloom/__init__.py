"""lexloom: governed multilingual concept recognition and text analytics on PySpark."""

__version__ = "0.1.0"
