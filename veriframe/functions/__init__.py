"""Column functions: rule scopes and null-safe predicates."""
