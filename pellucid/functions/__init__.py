"""Column functions of the checks."""
