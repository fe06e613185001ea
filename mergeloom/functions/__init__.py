"""Column functions and embedders."""
