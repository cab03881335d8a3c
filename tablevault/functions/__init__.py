"""Column expressions: scalar helpers and row fingerprints."""
