"""Lodestrand: content addressing, drift and evidence analytics on Spark DataFrames."""

__version__ = "0.1.0"
