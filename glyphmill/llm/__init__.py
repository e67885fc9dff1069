"""Operators for preparing language-model training data.

Nothing outside this package imports it; ``llm.registry`` holds the queries that the entry module
adds when the package is there.
"""
