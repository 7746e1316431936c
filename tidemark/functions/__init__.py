"""Column functions: text search, JSON and value conversion."""
