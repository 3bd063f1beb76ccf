"""Operators for preparing language-model training data.

Each module holds one operator; ``queries`` registers one query for each.
Nothing else in the library imports this subpackage.
"""
