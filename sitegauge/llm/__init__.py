"""Operators that prepare page texts as training data for language models.

Nothing outside this subpackage imports it.
"""
