"""Column expressions over texts, paths, citations and vectors."""
