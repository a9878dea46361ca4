"""Column expressions of map algebra, grids, classes and text."""
