"""Column and text functions."""
