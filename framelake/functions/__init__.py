"""Column functions: geometry, text parsing, units."""
