"""Column expressions: missing-aware comparison, calendar, normal law, hash draws."""
