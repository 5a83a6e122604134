"""Operators for building training data from large text corpora.

Nothing outside this folder imports it; ``queries`` lists the runnable queries.
"""
