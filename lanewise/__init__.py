"""Spark-native analytics over sequencing runs, sample sheets and read archives."""

__version__ = "0.1.0"
