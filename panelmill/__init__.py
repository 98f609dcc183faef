"""Panel analytics on Spark: data operators for any number of time series."""

__version__ = "0.1.0"
