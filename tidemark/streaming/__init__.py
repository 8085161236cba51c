"""streaming of the market-data library."""
