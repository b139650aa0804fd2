"""Scalar helpers: kernels, palettes, names."""
