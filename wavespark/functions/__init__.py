"""Column-level scalar functions (units, radix decoding)."""
