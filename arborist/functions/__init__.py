"""Scalar functions: the trees' instruction set and numeric guards."""
