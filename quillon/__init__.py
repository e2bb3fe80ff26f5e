"""quillon: record linkage and analytics operators as Spark DataFrame functions."""

__version__ = "0.1.0"
