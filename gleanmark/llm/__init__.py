"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Operators select the columns they need from their
input, so further columns of any name do no harm; each docstring says what nulls and empty texts give.
"""
