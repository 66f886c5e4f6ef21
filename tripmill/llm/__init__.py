"""Operators that prepare training text, and their queries. Nothing else in the library imports this package."""
