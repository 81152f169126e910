"""Operators on DataFrames of ways, points, edges and segments."""
