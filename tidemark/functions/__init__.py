"""Column expressions: everything here is a pure built-in Spark expression."""
