"""Column functions: text, numbers, JSON values and record values."""
