"""PySpark-native document intelligence engine."""

__version__ = "0.3.0"
