"""sources of timeweave."""
