"""Operators and queries for preparing language-model training text."""
