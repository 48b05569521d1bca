"""Column expressions for typed literals, facets and patterns."""
