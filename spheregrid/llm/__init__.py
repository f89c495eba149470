"""Operators for preparing language-model training data.

Everything here is optional: no other module of the package imports it.
"""
