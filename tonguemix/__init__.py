"""Language identification for documents that mix up to three languages, as Spark plans."""

__version__ = "0.1.0"
