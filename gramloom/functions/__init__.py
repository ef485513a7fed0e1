"""Column functions: level dictionaries, and what formulas may call."""
