"""Operators on points, rasters and clusters."""
