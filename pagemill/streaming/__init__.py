"""Streaming of pagemill."""
