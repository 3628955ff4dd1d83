"""Column expressions: geometry, terrain, clocks, weather."""
