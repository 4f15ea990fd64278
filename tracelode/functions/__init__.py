"""Column functions: text, validation, fixed values."""
