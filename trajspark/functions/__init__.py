"""Column helpers: geometry, text, scorers, tokens."""
