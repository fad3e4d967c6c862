"""Operators that prepare training text, one module each, with their queries."""
