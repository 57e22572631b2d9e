"""Column expressions: parsing, features, scores and small statistics."""
