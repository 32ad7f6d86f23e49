"""Column expressions: probability, pricing, scoring and name helpers."""
