"""Column functions: text normalization, tokens, similarities."""
