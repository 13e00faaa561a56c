"""Operators for training corpora: mixing, near-duplicates, tokens, language, toxicity, licences, search.

Nothing else in the library imports this subpackage.
"""
