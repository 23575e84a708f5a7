"""Ledgerlight: a Spark-first analytics engine for itemised money records."""

__version__ = "0.1.0"
