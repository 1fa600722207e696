"""Vectorised user-defined functions."""
