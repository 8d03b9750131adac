"""operators of timeweave."""
