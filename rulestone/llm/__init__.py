"""Operators of a training-data pipeline over tables of documents, vectors and conversations.

Nothing else in the library imports this subpackage.
"""
