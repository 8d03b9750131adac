"""functions of timeweave."""
