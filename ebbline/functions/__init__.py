"""Column functions: moments, distributions and rolling frames."""
