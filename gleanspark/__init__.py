"""Passive web and text intelligence on Spark DataFrames."""

__version__ = "0.1.0"
