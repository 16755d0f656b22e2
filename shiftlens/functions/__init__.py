"""Column expressions: parsing of catalog fields, type names, identifiers, scores."""
