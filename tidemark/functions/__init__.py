"""Column expressions: ordinal score arithmetic and text functions."""
