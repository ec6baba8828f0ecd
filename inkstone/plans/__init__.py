"""Queries built from the operators, and their SQL."""
