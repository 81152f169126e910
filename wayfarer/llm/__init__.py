"""Training-data operators: language, duplicates, contamination, personal data, tokens, archives.

Nothing else in the library imports this subpackage.
"""
