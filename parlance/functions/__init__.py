"""Column functions: prompt tokens, JSON text, image arithmetic, text predicates, pre-tokenization."""
