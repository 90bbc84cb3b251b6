"""Repeated word sequences by prefix-partitioned suffix trees.

A repeat is a sequence of ``width`` words (a window) that starts in two documents.
Suffixes are taken where a window's least ``PREFIX``-word hash lies, so equal windows
are anchored alike and about a fifth of all positions become suffixes.

1. One scan counts suffixes by prefix. A task sends each prefix once per block of
   documents, so a prefix that a third of all documents share costs an entry a block.
   Prefixes seen twice make their suffixes candidates; those with more than ``group``
   suffixes are listed. Their windows are suffixes of their own, counted by their first
   ``LONGER`` words; where that is still too many, the whole window is the prefix.
2. Candidates go back to their documents, which are kept in a table bucketed by
   document, so that later steps need not shuffle texts again.
3. Candidate suffixes travel as text, with the words to the left that windows at
   this anchor can reach. Prefix groups are owned by one task each; it sorts the
   suffixes of a group, whose common beginnings give the internal nodes of its subtree.
   A node of ``width`` words or more below which two documents hang is a repeat; the
   uppermost such node over a leaf has the least document of its window.
4. Occurrences join their suffix's result; documents lose the covered words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import parallelism, shared_folder, shared_table

WIDTH = 13
PREFIX = 4
LONGER = 8
GROUPS = 1 << 12, 1 << 18  # suffixes of a group: split beyond the first at small inputs, the second at large
LISTED = 1 << 16  # about so many groups are split at most between the two
BUCKET_BYTES = 64 << 20  # of text whose prefixes one bucket counts
MOST_BUCKETS = 1 << 16
BLOCK_WORDS = 4_000_000
CHUNK_BYTES = 4 << 20
NO_ID = (1 << 63) - 1
U64 = np.uint64


class Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""

    base = 0x9E3779B97F4A7C15

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.full(size, self.base, U64))
                self.down = np.cumprod(np.full(size, pow(self.base, -1, 1 << 64), U64))
        return self.up[:n], self.down[:n]


_powers = Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
        return h ^ (h >> U64(29))


def word_hashes(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a text joined by single spaces, and where words start."""
    hashes, starts, at = [], [], 0
    while at <= len(line):  # a long text slab by slab, cut at a space
        stop = line.find(b" ", at + CHUNK_BYTES)
        stop = len(line) if stop < 0 else stop
        raw = np.frombuffer(line, np.uint8)[at:stop]
        spaces = np.flatnonzero(raw == 32)
        start = np.concatenate([[0], spaces + 1])
        end = np.concatenate([spaces, [len(raw)]])
        up, down = _powers.upto(len(raw) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(raw) + 1, U64)
            np.cumsum(raw * up[:-1], out=total[1:])
            hashes.append(mixed((total[end] - total[start]) * down[start]))
        starts.append(start + at)
        at = stop + 1
    return np.concatenate(hashes), np.concatenate(starts)


class Anchors:
    """Suffix positions of several documents of one chunk.

    ``lines`` are texts joined by single spaces, each with ``width`` words or more.
    Anchor ``i`` lies in document ``doc[i]``, is its ``ord[i]``-th, has the prefix
    ``g[i]`` and stands for the windows at words ``first[i]`` to ``last[i]`` (counted
    in the document).
    """

    def __init__(self, lines: list[bytes], width: int):
        counts = np.array([x.count(b" ") + 1 for x in lines], np.int64)
        base = np.concatenate([[0], np.cumsum(counts)])
        h, self.start = word_hashes(b" ".join(lines))
        self.base, n = base, len(h)
        k = min(PREFIX, width)
        g = np.zeros(n - k + 1, U64)
        with np.errstate(over="ignore"):
            for j in range(k):
                g = mixed(g * U64(0x9E3779B97F4A7C15) + h[j : j + len(g)])
        at = np.arange(len(g))
        least, reach = g, 1
        while reach < width - k + 1:
            step = min(reach, width - k + 1 - reach)
            right = least[step:] < least[:-step]
            at = np.where(right, at[step:], at[:-step])
            least = np.where(right, least[step:], least[:-step])
            reach += step
        doc = np.repeat(np.arange(len(lines)), counts)
        window = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
        anchor = at[window]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[window[1:]] != doc[window[:-1]])]))
        self.g = g[anchor[new]]
        self.doc = doc[window[new]]
        self.first = window[new] - base[self.doc]
        self.last = window[np.append(new[1:], len(window)) - 1] - base[self.doc]
        heads = np.flatnonzero(np.concatenate([[True], self.doc[1:] != self.doc[:-1]]))
        self.ord = np.arange(len(new)) - np.repeat(heads, np.diff(np.append(heads, len(new))))


def chunks(rows: Iterator[tuple[int, bytes]], width: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts of ``width`` words or more, some megabytes at a time."""
    ids, lines, held = [], [], 0
    for i, line in rows:
        if line.count(b" ") + 1 < width:
            continue
        ids.append(i)
        lines.append(line)
        held += len(line)
        if held >= CHUNK_BYTES:
            yield ids, lines
            ids, lines, held = [], [], 0
    if ids:
        yield ids, lines


COUNTED = "kind string, bucket int, block long, a binary, b binary, c binary"
_COUNTED = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
CHOSEN = "doc_id long, mark long, ords binary"


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _count_prefixes(width: int, buckets: int, block_words: int):
    """Per block: rows ``E`` (prefixes by bucket), ``C`` (candidates known at once), ``D`` (its documents)."""

    def block_rows(block: int, ids: list, marks: list, found: list) -> list[tuple]:
        own = int(mixed(np.array([block], U64))[0] % U64(buckets))
        rows = [("D", own, block, np.array(ids, np.int64).tobytes(), np.array(marks, np.int64).tobytes(), None)]
        if not found:
            return rows
        g, doc, order = (np.concatenate(x) for x in zip(*found))
        by_g = np.argsort(g, kind="stable")
        g, doc, order = g[by_g], doc[by_g], order[by_g]
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        count = np.diff(np.append(head, len(g)))
        again = np.repeat(count > 1, count)
        rows.append(("C", own, block, doc[again].astype(np.uint32).tobytes(), order[again].astype(np.uint32).tobytes(), None))
        # what seldom repeats compresses: first occurrence if it is the only one, and the count
        place = np.stack([np.where(count > 1, -1, doc[head]), np.where(count > 1, -1, order[head]), count], 1).astype(np.int32)
        bucket = (g[head] % U64(buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        for b in range(buckets):
            part = by_bucket[cuts[b] : cuts[b + 1]]
            if len(part):
                part = part[np.argsort(place[part, 0], kind="stable")]
                rows.append(("E", b, block, g[head][part].tobytes(), np.ascontiguousarray(place[part, :2].T).tobytes(), place[part, 2].tobytes()))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        ids, marks, found, words = [], [], [], 0
        for batch in batches:
            doc_ids, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).to_pylist()
            rows = ((i, b" ".join((t or b"").split())) for i, t in enumerate(texts))
            for at, lines in chunks(rows, width):
                a = Anchors(lines, width)
                found.append((a.g, a.doc + len(ids), a.ord))
                ids += [doc_ids[i] for i in at]
                marks += [own[i] for i in at]
                words += int(a.base[-1])
                if words >= block_words:
                    yield _packed(block_rows(block, ids, marks, found), _COUNTED)
                    block, ids, marks, found, words = block + 1, [], [], [], 0
        if ids:
            yield _packed(block_rows(block, ids, marks, found), _COUNTED)

    return run


def _own_prefixes(group: int):
    """Rows of a bucket, bucket by bucket: candidates (``C``) and prefixes of large groups (``L``)."""

    def close(bucket: int, held: list[tuple]) -> pa.RecordBatch:
        g = np.concatenate([np.frombuffer(x[1], U64) for x in held])
        place = np.concatenate([np.frombuffer(x[2], np.int32).reshape(2, -1) for x in held], 1)
        count = np.concatenate([np.frombuffer(x[3], np.int32) for x in held]).astype(np.int64)
        of = np.repeat(np.arange(len(held)), [len(x[1]) // 8 for x in held])
        order = np.argsort(g, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], g[order][1:] != g[order][:-1]]))
        blocks = np.diff(np.append(head, len(g)))
        total = np.add.reduceat(count[order], head)
        rows = []
        if (large := g[order][head[total > group]]).size:
            rows.append(("L", bucket, None, large.tobytes(), None, None))
        hit = np.zeros(len(g), bool)
        hit[order] = np.repeat(blocks > 1, blocks)
        hit &= place[0] >= 0
        ends = np.searchsorted(of, np.arange(len(held) + 1))
        for i, x in enumerate(held):
            mine = place[:, ends[i] : ends[i + 1]][:, hit[ends[i] : ends[i + 1]]]
            if mine.shape[1]:
                rows.append(("C", bucket, x[0], mine[0].astype(np.uint32).tobytes(), mine[1].astype(np.uint32).tobytes(), None))
        return _packed(rows, _COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            through = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != "E":
                    through.append(row)
                    continue
                if row[1] != current:
                    if held:
                        yield close(current, held)
                    current, held = row[1], []
                held.append(row[2:])
            if through:
                yield _packed(through, _COUNTED)
        if held:
            yield close(current, held)

    return run


def _to_documents(table: pa.Table) -> pa.Table:
    """The rows ``D`` and ``C`` of one block to candidates by document."""
    ids = marks = None
    docs, ords = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    for kind, a, b in zip(*[table.column(n).to_pylist() for n in ("kind", "a", "b")]):
        if kind == "D":
            ids, marks = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
        else:
            docs.append(np.frombuffer(a, np.uint32))
            ords.append(np.frombuffer(b, np.uint32))
    doc, order = np.concatenate(docs), np.concatenate(ords)
    by_doc = np.lexsort((order, doc))
    doc, order = doc[by_doc], order[by_doc]
    has, head = np.unique(doc, return_index=True)
    ends = np.append(head[1:], len(doc))
    lists = [order[a:b].tobytes() for a, b in zip(head.tolist(), ends.tolist())]
    arrays = [pa.array(ids[has]), pa.array(marks[has]), pa.array(lists, pa.binary())]
    return pa.Table.from_arrays(arrays, names=["doc_id", "mark", "ords"])


def _words_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [b" ".join((t or b"").split()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array(words, pa.binary()), batch.column("ords")],
            names=["doc_id", "mark", "words", "ords"],
        )


def _suffixes(batches: Iterator[pa.RecordBatch], width: int, large: np.ndarray, larger: frozenset[int] | None) -> Iterator[tuple]:
    """(document id, mark, prefix key, text, first window) of each candidate of a table part.

    Without ``larger`` only the windows of large groups, with the key of their longer prefix.
    """
    longer = min(LONGER, width)
    for batch in batches:
        ids, marks = batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist()
        lines, chosen = batch.column("words").to_pylist(), batch.column("ords").to_pylist()
        for at, texts in chunks(((i, lines[i]) for i in range(len(ids)) if chosen[i]), width):
            a = Anchors(texts, width)
            count = np.bincount(a.doc, minlength=len(texts))
            offset = np.concatenate([[0], np.cumsum(count)])
            picked = np.concatenate([np.frombuffer(chosen[i], np.uint32) + offset[n] for n, i in enumerate(at)]).astype(np.int64)
            doc, first, last, g = a.doc[picked], a.first[picked], a.last[picked], a.g[picked]
            big = np.isin(g, large)
            if larger is None:
                doc, first, last, g, big = (x[big] for x in (doc, first, last, g, big))
            joined = b" ".join(texts)
            starts = np.append(a.start, len(joined) + 1)
            begin = starts[first + a.base[doc]]
            end = starts[last + width + a.base[doc]] - 1
            keys = g.view(np.int64).tolist()
            for n, d, s, e, k, f, l, b in zip(range(len(doc)), doc.tolist(), begin.tolist(), end.tolist(), keys, first.tolist(), last.tolist(), big.tolist()):
                row = at[d]
                if not b:
                    yield ids[row], marks[row], k, joined[s:e], f
                    continue
                for w in range(f, l + 1):  # the group is large: its windows have longer prefixes
                    word = w + int(a.base[d])
                    begin_at = int(starts[word])
                    text = joined[begin_at : int(starts[word + width]) - 1]
                    key = xxhash.xxh64_intdigest(joined[begin_at : int(starts[word + longer]) - 1], k & 0xFFFFFFFF) - (1 << 63)
                    if larger and key in larger:
                        key = xxhash.xxh64_intdigest(text, k & 0xFFFFFFFF) - (1 << 63)
                    yield ids[row], marks[row], key, text, w


_SUFFIX = pa.schema([("key", pa.int64()), ("text", pa.binary()), ("low", pa.int64()), ("high", pa.int64())])
_PLACE = pa.schema([("key", pa.int64()), ("print", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("first", pa.int64())])
_RESULT = pa.schema([("key", pa.int64()), ("print", pa.int64()), ("least", pa.list_(pa.int64()))])


def _print(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 5) - (1 << 63)


def _count_longer(width: int, large):
    """``key, n`` of the longer prefixes in large groups, added up by task as far as memory goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["key", "n"])

        for _, _, key, _, _ in _suffixes(batches, width, large.value, None):
            held[key] = held.get(key, 0) + 1
            if len(held) >= 500_000:
                yield out()
                held.clear()
        yield out()

    return run


def _emit_suffixes(width: int, large, larger):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list[int]] = {}
        size = 0

        def out():
            rows = [(k, t, lo, hi) for (k, t), (lo, hi) in held.items()]
            for i in range(0, len(rows), 20_000):
                yield _packed(rows[i : i + 20_000], _SUFFIX)

        for doc_id, _, key, text, _ in _suffixes(batches, width, large.value, larger.value):
            span = held.get((key, text))
            if span is None:
                held[key, text] = [doc_id, doc_id]
                size += len(text) + 200
                if size > 96 << 20:
                    yield from out()
                    held, size = {}, 0
            elif doc_id < span[0]:
                span[0] = doc_id
            elif doc_id > span[1]:
                span[1] = doc_id
        yield from out()

    return run


def shared_words(a: bytes, b: bytes) -> int:
    """How many words two texts begin with in common; each word ends with a space."""
    low, high = 0, min(len(a), len(b))
    while low < high:  # the longest common beginning, by halving
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return a.count(b" ", 0, low)


def internal_nodes(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """Internal nodes ``(depth, first leaf, last leaf)`` of a tree over sorted leaves, children first.

    ``common[i]`` is what leaves ``i`` and ``i + 1`` share; nodes of depth 0 are left out.
    """
    path = [(0, 0)]  # depth and first leaf of the nodes above the leaf at hand
    for i, depth in enumerate([*common, 0]):
        first = i
        while path[-1][0] > depth:
            own, first = path.pop()
            yield own, first, i
        if path[-1][0] < depth:
            path.append((depth, first))


def subtree(group: dict[bytes, list[int]], width: int) -> Iterator[tuple[bytes, list[int]]]:
    """The least document of each window, for suffix texts that have a repeat.

    ``group``: text to [least, largest] document. The leaves are the suffixes at every
    window of the texts. Nodes of ``width`` words or more are maximal repeats; of those
    above a leaf the uppermost one holds all places of the leaf's window.
    """
    if len(group) == 1:
        ((text, (low, high)),) = group.items()
        if low < high:
            yield text, [low] * (text.count(b" ") + 2 - width)
        return
    leaves, least = [], []
    for n, (text, (low, _)) in enumerate(group.items()):
        ended, at = text + b" ", 0
        windows = text.count(b" ") + 2 - width
        least.append([low] * windows)
        for i in range(windows):
            leaves.append((ended[at:], low, n, i))
            at = ended.index(b" ", at) + 1
    leaves.sort(key=lambda leaf: leaf[0])
    common = [shared_words(a[0], b[0]) for a, b in zip(leaves, leaves[1:])]
    for depth, first, last in internal_nodes(common):
        if depth >= width:  # a node comes after those below it, so the uppermost has the last word
            low = min(leaf[1] for leaf in leaves[first : last + 1])
            for _, _, n, i in leaves[first : last + 1]:
                least[n][i] = low
    for (text, (_, high)), found in zip(group.items(), least):
        if min(found) < high:
            yield text, found


def _own_suffixes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group, out = None, {}, []

        def close():
            out.extend((current, _print(text), found) for text, found in subtree(group, width))

        for batch in batches:
            for key, text, low, high in zip(*[c.to_pylist() for c in batch.columns]):
                if key != current:
                    if group:
                        close()
                    current, group = key, {}
                span = group.setdefault(text, [low, high])
                span[0], span[1] = min(span[0], low), max(span[1], high)
            if len(out) > 10_000:
                yield _packed(out, _RESULT)
                out = []
        if group:
            close()
        yield _packed(out, _RESULT)

    return run


def _emit_places(width: int, large, larger):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc_id, mark, key, text, first in _suffixes(batches, width, large.value, larger.value):
            rows.append((key, _print(text), doc_id, mark, first))
            if len(rows) >= 20_000:
                yield _packed(rows, _PLACE)
                rows = []
        yield _packed(rows, _PLACE)

    return run


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", _SPAN), ("kept", pa.string())])
OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, stop: long>>, kept string"


def _remove(width: int):
    def one(line: bytes, starts: list[int] | None) -> tuple[int, int, list, str]:
        words = line.split(b" ") if line else []
        if not starts:
            return len(words), 0, [], line.decode()
        cover = np.zeros(len(words) + 1, np.int64)
        at = np.unique(np.array(starts, np.int64))
        np.add.at(cover, at, 1)
        np.add.at(cover, at + width, -1)
        gone = np.cumsum(cover[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).reshape(-1, 2).tolist()
        kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
        return len(words), int(gone.sum()), [{"start": a, "stop": b} for a, b in edges], b" ".join(kept).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [None if i == NO_ID else i for i in batch.column("doc_id").to_pylist()]
            rows = map(one, batch.column("words").to_pylist(), batch.column("starts").to_pylist())
            yield _packed([(i, *r) for i, r in zip(ids, rows)], _OUT)

    return run


def _bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """A table in the shared folder, bucketed by document: joins on it leave texts where they are."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.bucketBy(buckets, "doc_id", "mark").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    group: int | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Remove words covered by a ``width``-word window that also starts in a smaller document.

    Returns ``id_col`` (long), ``n_words, n_removed``, the removed word ranges
    ``spans`` (start and stop) and ``kept`` (words joined by one space) per row. Words
    are ``[^\\x20\\x09-\\x0D]+``; windows are judged on the input. Null, empty and short
    texts lose nothing. A null id counts as larger than any other, and rows of one id
    are no smaller than each other; rows that repeat an id and its text get equal
    results. An empty table gives an empty result. Other columns are ignored.
    ``group`` and ``block_words`` bound memory and do not change results. By default a
    group holds from 2 ** 12 suffixes at small inputs to 2 ** 18 at large ones. The lists
    of large groups that are broadcast have at most (suffixes / ``group``) entries of 8
    bytes. The result is written to the shared folder; nothing stays in the catalog.
    """
    spark = docs.sparkSession
    narrow = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("mark"),
        F.col(text_col).cast("binary").alias("text"),
    )
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parallelism(spark), min(MOST_BUCKETS, size // BUCKET_BYTES))
    group = group or max(GROUPS[0], min(GROUPS[1], size // 30 // LISTED))
    counted = narrow.mapInArrow(_count_prefixes(width, buckets, block_words), COUNTED)
    owned = counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_own_prefixes(group), COUNTED)
    owned = shared_table(owned, "prefixes")
    large = [np.frombuffer(r.a, U64) for r in owned.where("kind = 'L'").select("a").collect()]
    large = spark.sparkContext.broadcast(np.concatenate([np.zeros(0, U64), *large]))

    chosen = owned.where("kind <> 'L'").groupBy("block").applyInArrow(_to_documents, CHOSEN)
    chosen = chosen.groupBy("doc_id", "mark").agg(F.first("ords").alias("ords"))
    texts = narrow.join(chosen, ["doc_id", "mark"], "left")
    name = f"tidemark_words_{uuid.uuid4().hex}"
    words = _bucketed(texts.mapInArrow(_words_joined, "doc_id long, mark long, words binary, ords binary"), name, parallelism(spark))

    held = words.where("ords is not null")
    larger = []
    if len(large.value):
        longer = held.mapInArrow(_count_longer(width, large), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        larger = [r.key for r in longer.where(F.col("n") > group).select("key").collect()]
    larger = spark.sparkContext.broadcast(frozenset(larger))
    suffixes = held.mapInArrow(_emit_suffixes(width, large, larger), "key long, text binary, low long, high long")
    found = suffixes.repartition("key").sortWithinPartitions("key").mapInArrow(_own_suffixes(width), "key long, print long, least array<long>")
    found = shared_table(found, "repeats")
    places = held.mapInArrow(_emit_places(width, large, larger), "key long, print long, doc_id long, mark long, first long")
    starts = F.expr("transform(filter(sequence(0, size(least) - 1), i -> least[i] < doc_id), i -> first + i)")
    hits = places.join(found, ["key", "print"]).select("doc_id", "mark", starts.alias("starts")).where("size(starts) > 0")
    hits = hits.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    result = words.drop("ords").join(hits, ["doc_id", "mark"], "left").mapInArrow(_remove(width), OUT)
    result = shared_table(result, "without-repeats")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return result.withColumnRenamed("doc_id", id_col)
