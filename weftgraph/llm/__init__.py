"""Operators for preparing large text and vector corpora.

Nothing else in the package imports this subpackage; it can be removed whole.
"""
