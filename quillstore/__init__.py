"""Collections of JSON documents, kept and queried on Spark."""

__version__ = "0.1.0"
