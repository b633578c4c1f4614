"""Operators for preparing training data: ten corpus-scale building blocks.

Nothing else in the library imports this subpackage.
"""
