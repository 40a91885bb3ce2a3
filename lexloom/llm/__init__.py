"""Operators for preparing language-model training data. Nothing else in lexloom imports this package."""
