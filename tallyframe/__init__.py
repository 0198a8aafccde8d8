"""Weighted-survey and housing-need analytics expressed as Spark DataFrames."""
