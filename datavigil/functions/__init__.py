"""Column expressions: patterns, validators, normalization, scores, masks, similarity."""
