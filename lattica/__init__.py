"""Lattica: a federated product-query engine expressed as lazy Spark plans."""

__version__ = "0.1.0"
