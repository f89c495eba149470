"""Gridded planetary and raster-style analytics as Spark DataFrame operations."""
