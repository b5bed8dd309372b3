"""Operators for preparing training data: each module is one operator, ``queries`` registers them.

Nothing outside this folder imports it, so the rest of the library works without it.
"""
