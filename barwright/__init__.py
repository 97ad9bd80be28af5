"""Barwright: time-series bar analytics declared as Spark plans."""

__version__ = "0.1.0"
