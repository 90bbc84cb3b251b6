"""Tidemark: declarative analytics for gridded, time-dependent data on Spark."""

__version__ = "0.1.0"
