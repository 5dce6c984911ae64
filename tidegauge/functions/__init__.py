"""Column and row functions."""
