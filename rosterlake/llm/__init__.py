"""Operators on texts for training data."""
