"""Operators on text and very large columns that a training-data pipeline needs. Nothing outside imports this package."""
