"""streaming of timeweave."""
