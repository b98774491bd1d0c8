"""Column functions: text normalization, qualifiers, similarity."""
