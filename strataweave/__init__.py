"""strataweave: corpus curation and multi-label evaluation on Spark DataFrames."""

__version__ = "0.1.0"
