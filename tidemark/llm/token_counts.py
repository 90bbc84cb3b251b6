"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a linked list; a heap holds the adjacent pairs that can merge,
by rank and place. Popping the lowest pair until none is left gives the number of
merges, and the count is the initial symbols minus the merges: no identifiers.
Counts of the words seen last are kept, so a word costs its merges once per task.
"""

from __future__ import annotations

import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 400_000
#: White space of Unicode (White_Space), as in the vocabulary's pattern language.
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_alphabet() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordCounts(dict):
    """word -> number of tokens; ``ranks`` maps a pair of symbols to (rank, merged)."""

    def __init__(self, ranks: dict, end_of_word: str):
        self.ranks, self.end, self.alphabet = ranks, end_of_word, byte_alphabet()

    def __missing__(self, word: str) -> int:
        symbols = [self.alphabet[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.end
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n = len(symbols) - merges(symbols, self.ranks)
        return n


def merges(symbols: list, ranks: dict) -> int:
    """How many merges byte-pair encoding makes in ``symbols`` (used up)."""
    n, done = len(symbols), 0
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(left: int) -> None:
        right = after[left]
        if right < n and (found := ranks.get((symbols[left], symbols[right]))):
            heap.append((found[0], left, right, symbols[left], symbols[right], found[1]))

    for i in range(n - 1):
        offer(i)
    heapq.heapify(heap)
    while heap:
        _, left, right, a, b, merged = heapq.heappop(heap)
        # stale if either symbol has changed since
        if symbols[left] != a or after[left] != right or symbols[right] != b:
            continue
        symbols[left], symbols[right] = merged, None
        after[left] = after[right]
        if after[left] < n:
            before[after[left]] = left
        done += 1
        for at in (before[left], left):
            if at >= 0:
                size = len(heap)
                offer(at)
                if len(heap) > size:
                    heapq._siftdown(heap, 0, len(heap) - 1)
    return done


class Counter:
    """Counts the tokens of texts as the vocabulary file's own pipeline would.

    The file must be a byte-level BPE whose normalizer is NFC and lower case and
    whose splitter keeps the matches of one pattern.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed":
            raise ValueError("not a vocabulary of the kind this counts")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ranks = {p: (i, p[0] + p[1]) for i, p in enumerate(pairs)}
        self.words = WordCounts(ranks, model["end_of_word_suffix"] or "")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")

    def count(self, text: str) -> int:
        parts = self.special.split(text)
        total = len(parts) - 1  # a special string is one token
        for part in parts:
            part = unicodedata.normalize("NFC", part)
            # no final-sigma rule: each character is lowered alone
            part = "".join(map(str.lower, part)) if "Σ" in part else part.lower()
            total += sum(map(self.words.__getitem__, self.pattern.findall(part)))
        return total


_counters: dict[tuple, Counter] = {}


def _counter(name: str, spec: str) -> Counter:
    """One per Python worker and vocabulary, so later tasks find the words counted."""
    key = (name, len(spec), hash(spec))
    if key not in _counters:
        _counters[key] = Counter(json.loads(spec))
    return _counters[key]


def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` per row.

    ``vocabulary`` is the path of a tokenizer file on the driver; its text (1 to 2
    MB) is broadcast, so executors need no copy. Null counts as empty: 0 bytes, 0
    tokens. Texts are counted whole, at any length; special strings inside a text
    count as one token. Repeated rows give repeated rows; an empty table gives an
    empty result. Other columns are ignored.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    name = os.path.basename(vocabulary)
    narrow = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = narrow.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(name, spec.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [counter.count(t) for t in texts]
            arrays = [
                batch.column(0),
                pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return narrow.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
