"""Column functions and the rule language."""
