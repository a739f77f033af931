"""Scalar, column and statistical functions."""
