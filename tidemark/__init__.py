"""tidemark: a PySpark-native library of analytics operators and the better plans behind them."""

__version__ = "0.1.0"
