"""Column expressions: text, rules, labels."""
