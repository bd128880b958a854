"""Geostatistics on regular grids, expressed as Spark DataFrames."""
