"""Operators over text corpora for training data; their queries are in ``queries``."""
