"""Fleet state analytics: what installations declare, report and do, as Spark DataFrames."""

__version__ = "0.1.0"
