"""DuckDB expressions that several oracles use."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """DuckDB's expression for the unsigned CRC-32 of an ASCII text."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    turn = "CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, s: {turn}), 4294967295)"
