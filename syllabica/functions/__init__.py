"""Column expressions: text, codes, JSON content and the geography lookups."""
