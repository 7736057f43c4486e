"""Column functions: spans, rules and check digits."""
