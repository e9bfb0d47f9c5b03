"""Matrica: feature-matrix and sequence analytics expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
