"""Column functions: character classes, text forms, tokens, ranges and ranks."""
