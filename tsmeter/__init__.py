"""Forecast evaluation and training-data operators as Spark DataFrame programs."""

__version__ = "1.0.0"
