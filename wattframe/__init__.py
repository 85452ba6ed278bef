"""wattframe: per-process energy and carbon attribution on Spark DataFrames."""

__version__ = "0.1.0"
