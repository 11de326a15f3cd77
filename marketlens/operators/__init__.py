"""Operators the plans are made of."""
