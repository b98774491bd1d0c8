"""Relational operators: registry cleaning, indexes, search, fusion, resolution, decisions."""
