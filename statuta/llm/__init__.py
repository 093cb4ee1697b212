"""Operators for preparing training and evaluation data."""
