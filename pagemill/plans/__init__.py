"""Plans of pagemill."""
