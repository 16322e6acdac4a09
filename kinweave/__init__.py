"""kinweave: entity resolution, event analytics and disclosure control on Spark DataFrames."""

__version__ = "0.1.0"
