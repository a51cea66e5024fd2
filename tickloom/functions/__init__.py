"""Column functions and factor expressions."""
