"""Operators for preparing language-model training data.

Everything here is optional: the rest of the library never imports this package.
"""
