"""Spark-native panel forecasting and table wrangling."""

__version__ = "0.1.0"
