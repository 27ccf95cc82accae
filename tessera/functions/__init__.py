"""Column functions with the numeric rules that array code expects."""
