"""Spark-first analytics over property-registry data."""

__all__ = ["__version__"]
__version__ = "0.1.0"
