"""Scalar and aggregate functions by their query names."""
