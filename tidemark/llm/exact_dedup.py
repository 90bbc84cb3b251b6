"""Exact deduplication over an extendible-hash index kept in shared files.

1. One scan writes the index files. A task keeps one *entry* per distinct text it
   has seen in its current block (text, key, number of rows, best row) and one
   *posting* per row (row address, entry). Copies inside a block collapse before
   anything is shuffled, so a text that makes up a third of all rows sends one
   entry per block.
2. The directory starts with one bucket. A bucket over capacity splits on its next
   key bit; a split of a bucket as deep as the directory doubles the directory.
   Bucket sizes come from a histogram over the leading key bits of the index,
   whose number of cells is bounded by ``2 ** MAX_DEPTH``.
3. Each bucket is a contiguous key range owned by one task. The owner walks its
   entries in key order, chains the texts that share a key and compares their
   bytes; equal bytes make a group.
4. Verdicts go back to the postings by entry. Entries of a large group belong to
   many blocks, so that join is even.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import parallelism, shared_table

MAX_DEPTH = 16
BUCKET_BYTES = 32 << 20
BLOCK_BYTES = 64 << 20

INDEX_SCHEMA = (
    "is_entry boolean, entry long, key long, digest binary, text binary, n long, "
    "doc_id long, row long"
)
VERDICT_SCHEMA = "entry long, keep_id long, keep_row long, group_size long"


def _arrow(rows: list[tuple], names: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for c, (_, t) in zip(columns, names)], names=[n for n, _ in names]
    )


_INDEX = [
    ("is_entry", pa.bool_()), ("entry", pa.int64()), ("key", pa.int64()), ("digest", pa.binary()),
    ("text", pa.binary()), ("n", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()),
]
_VERDICT = [(n, pa.int64()) for n in ("entry", "keep_id", "keep_row", "group_size")]


def better(a: tuple, b: tuple) -> bool:
    """Whether row ``a`` stays rather than ``b``; each is (doc_id or None, row address)."""
    return (a[0] is not None, a[0] or 0, -a[1]) > (b[0] is not None, b[0] or 0, -b[1])


def _index_writer(key_bits: int, block_bytes: int):
    mask = (1 << 64) - (1 << (64 - key_bits))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        row, held, open_entries = base, 0, {}

        def flush():
            rows = [
                (True, e, key, digest, text, n, best[0], best[1])
                for digest, held_texts in open_entries.items()
                for text, (e, key, n, best) in held_texts.items()
            ]
            for at in range(0, len(rows), 2000):
                yield _arrow(rows[at : at + 2000], _INDEX)
            open_entries.clear()

        for batch in batches:
            postings = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or b""
                digest = hashlib.sha256(text).digest()
                texts = open_entries.setdefault(digest, {})
                if text in texts:
                    entry = texts[text]
                    entry[2] += 1
                    if better((doc_id, row), entry[3]):
                        entry[3] = (doc_id, row)
                else:
                    key = int.from_bytes(digest[:8], "big") & mask
                    key -= (key >> 63) << 64
                    entry = texts[text] = [row, key, 1, (doc_id, row)]
                    held += len(text)
                postings.append((False, entry[0], None, digest, None, None, doc_id, row))
                row += 1
            if postings:
                yield _arrow(postings, _INDEX)
            if held > block_bytes:
                yield from flush()
                held = 0
        yield from flush()

    return write


def split_directory(cells: dict[int, int], depth: int, capacity: int) -> list[int]:
    """The directory of an extendible hash over keys with ``cells[prefix]`` bytes.

    Returns, for each of the ``2 ** depth`` leading-bit prefixes, its bucket;
    buckets are numbered in key order. A bucket splits while it holds more than
    ``capacity`` bytes and has a key bit left.
    """
    directory, local, level = [0], {0: 0}, 0
    sizes = {0: sum(cells.values())}
    members = {0: cells}
    todo, used = [0], 1
    while todo:
        bucket = todo.pop()
        if sizes[bucket] <= capacity or local[bucket] == depth:
            continue
        if local[bucket] == level:
            directory = [b for b in directory for _ in (0, 1)]
            level += 1
        other, used = used, used + 1
        local[bucket] += 1
        local[other] = local[bucket]
        bit = depth - local[bucket]
        members[other] = {c: n for c, n in members[bucket].items() if c >> bit & 1}
        members[bucket] = {c: n for c, n in members[bucket].items() if not c >> bit & 1}
        for b in (bucket, other):
            sizes[b] = sum(members[b].values())
        first = directory.index(bucket)
        span = directory.count(bucket) // 2
        directory[first + span : first + 2 * span] = [other] * span
        todo += [bucket, other]
    full = [directory[c >> (depth - level)] for c in range(1 << depth)]
    order: dict[int, int] = {}
    return [order.setdefault(b, len(order)) for b in full]


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in key order: chain the texts of a key, compare bytes, merge equal ones."""
    current, chain, out = None, [], []

    def close():
        for _, total, best, entries in chain:
            out.extend((e, best[0], best[1], total) for e in entries)

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("key", "text", "entry", "n", "doc_id", "row")]
        for key, text, entry, n, doc_id, row in zip(*columns):
            if key != current:
                close()
                current, chain = key, []
            for link in chain:
                if link[0] == text:
                    link[1] += n
                    if better((doc_id, row), link[2]):
                        link[2] = (doc_id, row)
                    link[3].append(entry)
                    break
            else:
                chain.append([text, n, (doc_id, row), [entry]])
        if len(out) >= 4000:
            yield _arrow(out, _VERDICT)
            out = []
    close()
    if out:
        yield _arrow(out, _VERDICT)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    block_bytes: int = BLOCK_BYTES,
    key_bits: int = 64,
) -> DataFrame:
    """Group rows with byte-identical texts; the row with the largest id stays.

    Returns one row per input row: ``id_col, keep_id, group_size, kept,
    text_sha256``. A null text counts as empty. A null id loses to any other; rows
    that repeat an id and its text count singly in ``group_size`` and one of them
    stays. An empty table gives an empty result. Other columns are ignored, so
    their names cannot clash. ``key_bits`` shortens the key (tests force chains
    with it); results do not depend on it, nor on ``bucket_bytes`` or
    ``block_bytes``.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    index = shared_table(narrow.mapInArrow(_index_writer(key_bits, block_bytes), INDEX_SCHEMA), "exact-index")
    entries = index.where("is_entry")

    total = entries.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    capacity = max(1, min(bucket_bytes, total // parallelism(spark)))
    depth = min(MAX_DEPTH, max(1, (4 * total // capacity).bit_length()))
    cell = F.shiftrightunsigned("key", 64 - depth).cast("int")
    histogram = entries.groupBy(cell.alias("cell")).agg(F.sum(F.octet_length("text") + 64).alias("bytes"))
    directory = split_directory({r.cell: r.bytes for r in histogram.collect()}, depth, capacity)
    lookup = spark.createDataFrame(list(enumerate(directory)), "cell int, bucket int")

    # The directory has at most 2 ** MAX_DEPTH rows of two integers, whatever the input.
    owned = (
        entries.withColumn("cell", cell)
        .join(F.broadcast(lookup), "cell")
        .select("bucket", "key", "text", "entry", "n", "doc_id", "row")
        .repartitionById(max(directory) + 1, F.col("bucket"))
        .sortWithinPartitions("key", "entry")
    )
    verdicts = owned.mapInArrow(_own, VERDICT_SCHEMA)
    postings = index.where("not is_entry").select("entry", "digest", "doc_id", "row")
    return postings.join(verdicts, "entry").select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
