"""Brackenspan: schema-flexible document and event analytics, declared on Spark."""

__version__ = "0.1.0"
