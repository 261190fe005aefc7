"""Functions of pagemill."""
