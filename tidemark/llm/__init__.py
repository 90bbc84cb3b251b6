"""Operators of a training-data pipeline: deduplication, filters, tokenizers, mixing.

Nothing outside this subpackage imports it.
"""
