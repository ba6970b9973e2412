"""Scalar functions and features as column expressions."""
