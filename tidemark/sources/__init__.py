"""sources of the market-data library."""
