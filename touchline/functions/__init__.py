"""Column builders: scoring rules, rounding rules and labels."""
