"""functions of the market-data library."""
