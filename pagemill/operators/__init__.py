"""Operators of pagemill."""
