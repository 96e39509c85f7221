"""Scalar helpers that the operators share."""
