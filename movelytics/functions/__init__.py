"""Column expressions: keys, clocks, geometry, wind. No Python UDFs."""
