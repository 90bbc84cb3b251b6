"""Tidemark subpackage."""
