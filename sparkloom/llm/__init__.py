"""Operators for preparing training text: dedup, tokens, packing, filters, search.

Nothing outside this subpackage imports it; ``queries`` registers its queries.
"""
