"""Column expressions: units, clock, geometry and volume-delay formulas."""
