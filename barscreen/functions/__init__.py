"""Column expressions: cleaning, trailing means, conditions, formatting."""
