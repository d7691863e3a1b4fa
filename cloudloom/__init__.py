"""cloudloom: point-cloud and multi-view label analytics on Spark DataFrames."""

__version__ = "0.1.0"
