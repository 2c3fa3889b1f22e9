"""Column functions and the pure row functions behind the few Arrow UDFs."""
