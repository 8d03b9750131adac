"""plans of timeweave."""
