"""Operators for preparing language-model training data, one module each.

Nothing outside this subpackage imports it; ``queries`` holds what ``__spark_entry__`` registers.
"""
