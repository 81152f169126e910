"""Column functions: geodesy, grid, tag parsing, dimensions."""
