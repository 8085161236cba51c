"""plans of the market-data library."""
