"""Lakehouse operators and credit tables for a retail bank, as PySpark DataFrame plans."""

__version__ = "0.1.0"
