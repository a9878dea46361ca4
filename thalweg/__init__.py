"""Elevation rasters and river depth on Spark DataFrames."""
