"""Training-data operators: text, conversations, pages and mixtures.

Nothing else in the library imports this subpackage.
"""
