"""Operators for preparing training data: scoring, formatting, deduplication, mixing, packing and file formats.

Nothing outside this package imports it; its queries are in ``queries`` and
their SQL in ``oracle``.
"""
