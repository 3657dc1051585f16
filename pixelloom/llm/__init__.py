"""Operators for preparing language-model training data: ten of them, and nothing else in the package uses them."""
