"""Scalar functions of the light-curve models as column expressions."""
