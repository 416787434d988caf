"""Operators that clean, match and mix training data."""
