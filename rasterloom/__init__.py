"""Raster analytics on Spark DataFrames."""
