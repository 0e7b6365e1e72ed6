"""quantloom: a PySpark-native engine for market time series research."""

__version__ = "0.1.0"
