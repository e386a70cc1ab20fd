"""Operators for building training corpora: reading, cleaning, scoring, deduplicating, mixing and formatting text.

Nothing outside this subpackage imports it.
"""
