"""Operators for preparing training text at scale.

Nothing outside this package imports it; it imports nothing from the rest of the library.
"""
