"""Similar documents: SimHash candidates and bands of minima, verified by Jaccard similarity.

Candidate pairs come from two sides. SimHash fingerprints over five-word shingles that
differ in at most three bits are found by multi-index hashing; that alone cannot reach
a similarity of 0.8, where about ten of 64 bits differ. So candidates also share a
band of minima: a text's shingles are hashed ``BANDS * ROWS`` times, the least of each
are kept, and ``ROWS`` minima together are a band's key. Two texts of similarity s
share a band with probability 1 - (1 - s ** ROWS) ** BANDS, that is 0.9995 at 0.8. A
candidate pair is joined to its texts and its similarity computed exactly, so no
pair below the bound links.

Texts that share a key form a run, in an order of chance that differs by band. The
first ``RUN_ALL`` of a run meet one another; a later one meets the first and the
``RUN_NEAR`` before it. That connects nearly all of a large group of copies with
pairs in proportion to its size. What longer runs may still lack is compared in a
second step: of each run that lies in more than one group by then, every text meets
every text outside the run's largest group, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import arrow_rows, shared_table
from tidemark.llm.simhash import fingerprint, simhash_links

WIDTH = 5
SIMILARITY = (4, 5)  # at least four fifths
BANDS, ROWS = 25, 6
RUN_ALL, RUN_NEAR = 16, 4
CHUNK = 1024
TEXTS_AT_ONCE = 500
TEXTS_A_BATCH, TEXTS_KNOWN = 1000, 16
BLOCK, PROBES = 128, 1024  # texts held and texts compared with them in one unit of the second step


def shingles(text: bytes | None, width: int = WIDTH) -> frozenset[bytes]:
    """The ``width``-word shingles; a shorter text is one, whatever it holds."""
    words = (text or b"").lower().split()  # bytes: only A-Z and ASCII white space
    return frozenset(b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def similar(a: frozenset[bytes], b: frozenset[bytes]) -> bool:
    both = len(a & b)
    return SIMILARITY[1] * both >= SIMILARITY[0] * (len(a) + len(b) - both)


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    odd = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def band_keys(parts: frozenset[bytes]) -> np.ndarray:
    """The key of each band."""
    odd, plus = _FACTORS
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, 7) for x in parts), np.uint64, len(parts))
    least = np.full(len(odd), np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), CHUNK):
            mixed = hashes[at : at + CHUNK, None] * odd + plus
            mixed ^= mixed >> np.uint64(32)
            least = np.minimum(least, (mixed * odd).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([digest(row.tobytes(), band) for band, row in enumerate(rows)], np.uint64)


_FACTORS = _factors()


def _emit_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(at, TEXTS_AT_ONCE)
            keys, sizes = [], []
            for text in part.column(1):  # one text's shingles at a time
                parts = shingles(text.as_py())
                keys.append(band_keys(parts))
                sizes.append(len(parts))
            node, size = np.repeat(part.column(0).to_numpy(), BANDS), np.repeat(np.array(sizes, np.int64), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(node), pa.array(size)], names=["key", "node", "size"])


_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64()), ("size", pa.int64())])
FOUND = "u long, v long, key long, size long"


def _emit_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key to pairs whose sizes allow the similarity.

    All rows of a run over ``RUN_ALL`` come out too, as ``u`` with key and size, ``v`` null.
    """
    key, held, n = None, [], 0  # the run's first, then its last rows
    for batch in batches:
        out = []
        for k, node, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if k != key:
                key, held, n = k, [], 0
            others = held if n < RUN_ALL else [held[0], *held[-RUN_NEAR:]]
            for other, other_size in others:
                if SIMILARITY[1] * min(size, other_size) >= SIMILARITY[0] * max(size, other_size):
                    out.append((min(node, other), max(node, other), None, None))
            if n == RUN_ALL:
                out += [(x, None, key, y) for x, y in held]
            if n >= RUN_ALL:
                out.append((node, None, key, size))
            n += 1
            held.append((node, size))
            if len(held) > RUN_ALL:
                held = [held[0], *held[-RUN_NEAR:]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND)], schema=_FOUND)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t, WIDTH) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["node", "fp"])


def _simhash_pairs(texts: DataFrame) -> DataFrame:
    """Pairs of nodes that connect fingerprints of three or fewer differing bits; equal ones as stars."""
    prints = shared_table(texts.select("node", "text").mapInArrow(_fingerprints, "node long, fp long"), "similar-prints")
    least = shared_table(prints.groupBy("fp").agg(F.min("node").alias("least")), "similar-distinct")
    links = simhash_links(least)
    one, two = (least.select(F.col("fp").alias(x), F.col("least").alias(f"node_{x}")) for x in ("u", "v"))
    across = links.join(one, "u").join(two, "v").select(F.col("node_u").alias("a"), F.col("node_v").alias("b"))
    same = prints.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return across.unionByName(same).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = lru_cache(TEXTS_KNOWN)(shingles)
    for batch in batches:
        keep = [similar(known(a.as_py()), known(b.as_py())) for a, b in zip(batch.column(2), batch.column(3))]
        out = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        if out.num_rows:
            yield out


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    one = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    two = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b").mapInArrow(_verified, "u long, v long")


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of (key, block, chunk), held rows before probes, to the similar pairs among them."""
    unit, held = None, []
    for batch in batches:
        out = []
        for *own, probe, node, group, text in zip(*(c.to_pylist() for c in batch.columns)):
            if own != unit:
                unit, held = own, []
            parts = shingles(text)
            if not probe:
                held.append((node, group, parts))
                continue
            for other, other_group, others in held:
                sizes = len(parts), len(others)
                if group != other_group and SIMILARITY[1] * min(sizes) >= SIMILARITY[0] * max(sizes) and similar(parts, others):
                    out.append((min(node, other), max(node, other)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*set(out))], names=["u", "v"])


def _rest_of_runs(runs: DataFrame, groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Links across groups in ``runs(key, node)`` that ``groups(node, component)`` lacks.

    A unit holds at most about ``BLOCK`` texts outside the run's largest group and
    ``PROBES`` of the run's texts, however long the run.
    """
    named = runs.join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    counts = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    totals = counts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most"))
    open_runs = totals.where("n > most.n").select(
        "key", F.col("most.component").alias("largest"),
        F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n") / PROBES).cast("int").alias("chunks"),
    )
    rows = shared_table(named.join(open_runs, "key"), "similar-rest")
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = rows.where("component <> largest").select("key", own("blocks").alias("block"), each("chunks").alias("chunk"), F.lit(False).alias("probe"), "node", "component")
    probes = rows.select("key", each("blocks").alias("block"), own("chunks").alias("chunk"), F.lit(True).alias("probe"), "node", "component")
    units = held.unionByName(probes).join(texts.select("node", "text"), "node").select("key", "block", "chunk", "probe", "node", "component", "text")
    units = units.repartition("key", "block", "chunk").sortWithinPartitions("key", "block", "chunk", "probe")
    return units.mapInArrow(_compare_blocks, "u long, v long").distinct()


def similar_groups(texts: DataFrame) -> DataFrame:
    """``(node, component)`` of what the similar pairs of ``texts(node long, text binary)`` connect.

    One row a node; nodes without a similar one are left out.
    """
    with arrow_rows(texts.sparkSession, TEXTS_A_BATCH):
        return _similar_groups(texts)


def _similar_groups(texts: DataFrame) -> DataFrame:
    keyed = texts.select("node", "text").mapInArrow(_emit_bands, "key long, node long, size long")
    runs = keyed.repartition("key").withColumn("rank", F.xxhash64("key", "node")).sortWithinPartitions("key", "rank")
    found = shared_table(runs.select("key", "node", "size").mapInArrow(_emit_pairs, FOUND), "similar-found")
    pairs = found.where("v is not null").select("u", "v").unionByName(_simhash_pairs(texts)).distinct()
    links = shared_table(_verify(pairs, texts), "similar-links")
    groups = shared_table(connected_components(links), "similar-first")
    more = shared_table(_rest_of_runs(found.where("v is null").select("key", F.col("u").alias("node")), groups, texts), "similar-more")
    if more.isEmpty():
        return groups
    return connected_components(links.unionByName(more))


def one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of similar texts: the smallest id (long).

    Texts are similar if their sets of five-word shingles (ASCII letters in lower
    case) have a Jaccard similarity of 0.8 or more; a group is what such pairs
    connect. Texts without words are equal to one another. Of rows that repeat the
    smallest id the one with the least text hash stays, once; a null id is larger
    than any other; null, empty and blank texts are one group, of which one row stays.
    An empty table gives an empty result. All columns come back, whatever their names.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    key, text = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"
    own_id = F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("doc_id")
    node = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("node")
    places = plain.select(own_id, node, F.col(text).cast("binary").alias("text"))
    distinct = shared_table(places.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("text").alias("text")), "similar-texts")
    groups = shared_table(similar_groups(distinct), "similar-groups")
    named = distinct.select("node", "first").join(groups, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    stays = named.groupBy("component").agg(F.min(F.struct(F.col("first").alias("doc_id"), "node")).alias("stay"))
    joined = plain.select("*", own_id, node).join(stays.select("stay.*"), ["doc_id", "node"], "left_semi")
    unique = joined.dropDuplicates(["doc_id", "node"])
    return unique.select(*[F.col(c).alias(n) for c, n in zip(plain.columns, columns)])
