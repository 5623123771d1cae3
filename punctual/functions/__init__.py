"""Column expressions: cleaning, labels, features, hashing."""
