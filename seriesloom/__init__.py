"""seriesloom: calibrated, causal, keyed measurement series on Spark DataFrames."""

__version__ = "0.1.0"
