"""Operators for large training-text collections. Nothing else in the library imports this package."""
