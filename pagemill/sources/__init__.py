"""Sources of pagemill."""
