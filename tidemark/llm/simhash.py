"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two 32-bit segments. If two fingerprints differ in at
most three bits, one segment differs in at most one, so the Hamming ball of radius
one around a segment holds the other's segment. Of two segments one bit apart only
the one with that bit set looks it up (it clears the bit), which halves the ball.

Table rows and lookups meet by segment value in sorted runs; complete distances are
verified with NumPy and a run yields a spanning forest of its links, never all
pairs. A run over ``RUN_LIMIT`` is split once more by the 16-bit segments of the
other half, where at most one bit differs again; such a key fixes all but 16 bits up
to the ball around it, so what a run can hold is bounded at any scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import shared_table

DISTANCE = 3
RUN_LIMIT = 4096


def fingerprint(text: bytes | None, width: int) -> int:
    """64-bit SimHash over the XXH64 of ``width``-word shingles, repeats included."""
    words = (text or b"").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, width) for t in batch.column(2).to_pylist()]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signed)], names=["doc_id", "mark", "fp"])

    return run


def _keys(value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each value itself and of it with one set bit cleared."""
    rows, keys = [np.arange(len(value))], [value]
    for bit in range(bits):
        mask = np.uint64(1 << bit)
        hit = np.nonzero(value & mask)[0]
        rows.append(hit)
        keys.append(value[hit] & ~mask)
    return np.concatenate(rows), np.concatenate(keys)


def _batch(key: np.ndarray, sub: np.ndarray, fp: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(key.view(np.int64)), pa.array(sub), pa.array(fp.view(np.int64)), pa.array(own)]
    return pa.RecordBatch.from_arrays(arrays, names=["key", "sub", "fp", "own"])


KEYED = "key long, sub int, fp long, own boolean"


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for segment in (0, 1):
            value = fp >> np.uint64(32) if segment else fp & np.uint64(0xFFFFFFFF)
            rows, keys = _keys(value, 32)
            keys = keys | np.uint64(segment << 32)
            yield _batch(keys, np.full(len(rows), -1, np.int32), fp[rows], np.arange(len(rows)) < len(fp))


def _emit_subkeys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that were too long: add the 16-bit segments of the other half to the key."""
    for batch in batches:
        batch = batch.filter(batch.column("overflow"))
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy().view(np.uint64)
        fp = batch.column("fp").to_numpy().view(np.uint64)
        other = np.where(key >> np.uint64(32), fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32))
        for segment in (0, 1):
            value = other >> np.uint64(16) if segment else other & np.uint64(0xFFFF)
            rows, sub = _keys(value, 16)
            yield _batch(key[rows], (sub | np.uint64(segment << 16)).astype(np.int32), fp[rows], np.arange(len(rows)) < len(fp))


LINKS = "overflow boolean, key long, fp long, u long, v long"


def links_in_run(fp: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links (``DISTANCE`` or fewer bits) among distinct ``fp``."""
    left, right, rest, frontier = [], [], fp, []
    while len(rest) or frontier:
        if not frontier:
            frontier, rest = [rest[0]], rest[1:]
        at = frontier.pop()
        if not len(rest):
            continue
        near = np.bitwise_count(rest ^ at) <= DISTANCE
        found = rest[near]
        left += [int(at)] * len(found)
        right += found.tolist()
        frontier += list(found)
        rest = rest[~near]
    return left, right


def _match(limit: int | None):
    """Sorted keyed rows to links; with a limit, longer runs come out as overflow."""

    names = ["overflow", "key", "fp", "u", "v"]

    def out_links(u: list[int], v: list[int]) -> pa.RecordBatch:
        none = pa.nulls(len(u), pa.int64())
        a, b = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v))
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(u), bool)), none, none, a, b], names=names)

    def out_rows(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(key), pa.int64())
        arrays = [pa.array(np.ones(len(key), bool)), pa.array(key), pa.array(fp.view(np.int64)), none, none]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def closed(key, sub, fp, own, starts) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.append(starts, len(key)))
        owns = np.add.reduceat(own.astype(np.int64), starts)
        left, right = [], []
        worth = (sizes > 1) & (owns > 0)
        for at, n in zip(starts[worth].tolist(), sizes[worth].tolist()):
            if limit is not None and n > limit:
                yield out_rows(key[at : at + n], fp[at : at + n])
                continue
            distinct = np.unique(fp[at : at + n])
            if len(distinct) > 1:
                u, v = links_in_run(distinct)
                left += u
                right += v
        if left:
            yield out_links(left, right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None  # the run that may go on in the next batch: key, sub, fp, own
        spilling = None  # (key, sub) of a run that went over the limit
        for batch in batches:
            part = [
                batch.column("key").to_numpy(),
                batch.column("sub").to_numpy(),
                batch.column("fp").to_numpy().view(np.uint64),
                batch.column("own").to_numpy(zero_copy_only=False),
            ]
            if tail is not None:
                part = [np.concatenate(x) for x in zip(tail, part)]
            key, sub, fp, own = part
            if not len(key):
                continue
            cuts = np.nonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1]))[0] + 1
            starts = np.concatenate([[0], cuts])
            last = int(starts[-1])
            if spilling == (key[0], sub[0]):
                end = int(starts[1]) if len(starts) > 1 else len(key)
                yield out_rows(key[:end], fp[:end])
                if end == len(key):
                    continue  # it may go on
                key, sub, fp, own = (x[end:] for x in (key, sub, fp, own))
                starts, last = starts[1:] - end, last - end
            spilling, tail = None, [x[last:].copy() for x in (key, sub, fp, own)]
            if limit is not None and len(key) - last > limit:
                spilling, tail = (key[last], sub[last]), None
                yield out_rows(key[last:], fp[last:])
            if last:
                yield from closed(key[:last], sub[:last], fp[:last], own[:last], starts[:-1])
        if tail is not None:
            yield from closed(*tail, np.array([0]))

    return run


def simhash_links(prints: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that connect the distinct ``fp`` values as all pairs would."""
    keyed = prints.select("fp").mapInArrow(_emit_keys, KEYED)
    sort = lambda df: df.repartition("key", "sub").sortWithinPartitions("key", "sub")
    first = shared_table(sort(keyed).mapInArrow(_match(RUN_LIMIT), LINKS), "simhash-links")
    again = sort(first.where("overflow").mapInArrow(_emit_subkeys, KEYED)).mapInArrow(_match(None), LINKS)
    return first.where("not overflow").unionByName(again).select("u", "v")


def _groups(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, mark, fp, component_id, component`` for ``docs(doc_id, mark, text)``.

    ``component`` is the least fingerprint of the group, so it names one group only
    even where ids repeat.
    """
    kind = dict(docs.dtypes)["doc_id"]
    prints = shared_table(docs.mapInArrow(_fingerprints(width), f"doc_id {kind}, mark long, fp long"), "simhash")
    distinct = shared_table(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    groups = connected_components(simhash_links(distinct))
    named = distinct.join(groups, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    verdict = shared_table(named.join(least, "component").select("fp", "component_id", "component"), "simhash-groups")
    return prints.join(verdict, "fp")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3
) -> DataFrame:
    """``id_col, fingerprint, component_id`` per row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits. Rows link when fingerprints differ
    in at most three bits; ``component_id`` is the smallest id reachable. Null,
    empty and blank texts have fingerprint zero and link like any other. A text
    shorter than the shingle hashes as a whole. Null ids never name a component;
    one whose ids are all null gets null. Repeated rows give repeated rows; an empty
    table an empty result. Other columns are ignored. Copies share a fingerprint and
    are reduced to it before matching.
    """
    marked = docs.select(F.col(id_col).alias("doc_id"), F.lit(0).cast("long").alias("mark"), F.col(text_col).cast("binary").alias("text"))
    return _groups(marked, width).select(
        F.col("doc_id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (long).

    Of rows that repeat that id the one with the least text hash stays, once. A row
    with a null id stays only if its component has no other, once. All columns come
    back, whatever their names.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    key, text = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"
    own_id, mark = F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.xxhash64(text).alias("mark")
    narrow = docs.select(F.col(id_col).alias(key), F.col(text_col).alias(text))
    groups = _groups(narrow.select(own_id, mark, F.col(text).cast("binary").alias("text")), width)
    stays = groups.where("doc_id = component_id").groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("stay"))
    joined = plain.select("*", own_id, mark).join(stays.select("stay.*"), ["doc_id", "mark"], "left_semi")
    unique = joined.dropDuplicates(["doc_id", "mark"])
    return unique.select(*[F.col(c).alias(n) for c, n in zip(plain.columns, columns)])
