"""Column expressions: tokenizers, n-grams, hashing, statistics."""
