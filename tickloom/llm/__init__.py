"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; ``queries.py`` holds its registered queries.
"""
