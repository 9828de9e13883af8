"""Column functions over texts, token lists, counts and vectors."""
