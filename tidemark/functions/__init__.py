"""Column expressions: text, time, arrays, identities."""
