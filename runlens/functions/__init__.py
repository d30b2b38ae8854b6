"""Column functions: text rules and rate formulas."""
