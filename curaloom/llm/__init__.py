"""Operators for large training corpora.

Each module holds one operator with its own general interface; ``queries``
derives the registered queries from them.  Nothing outside this package imports
it.
"""
