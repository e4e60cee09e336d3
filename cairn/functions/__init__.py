"""Column expressions: URLs, text, cell values, queries and pages."""
