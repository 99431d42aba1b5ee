"""Operators for preparing and checking training data. Nothing outside imports this package."""
