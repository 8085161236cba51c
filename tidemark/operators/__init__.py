"""operators of the market-data library."""
