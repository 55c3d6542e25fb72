"""Scalar column helpers (F1-F14) and driver-side distribution functions."""
