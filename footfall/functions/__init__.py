"""Column expressions: local time, rounding, step functions, labels."""
