"""Operators for training-data pipelines over documents, vectors and conversations.

Nothing else in the library imports this subpackage; ``queries.py`` holds what the entry
module registers.
"""
