"""Wavelet-coded still images as Spark tables, and operators for training data."""
