"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_table

CHUNK = 200_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what the edges connect: each node with its component's least."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[label[rest]], nodes[rest]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out():
        u = np.concatenate([b.column(0).to_numpy() for b in held])
        v = np.concatenate([b.column(1).to_numpy() for b in held])
        low, high = forest(u, v)
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u long, v long)``.

    The component is its smallest node. Each round hangs every node's larger
    neighbours, then its smaller ones, on the smallest node it knows; minima are
    partially aggregated, and the joins back hold one row per node on one side, so
    a node with very many edges is split like any skewed join key. Rounds end when
    the edges stay as they are. Loops and repeated edges do no harm; no edges give
    no rows.
    """
    edges = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    edges = shared_table(edges.mapInArrow(_contract, "u long, v long").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()
        # small star: hang a node and its smaller neighbours on the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("u"), F.col("u").alias("w"), "v")
        small = small.select("u", F.explode(F.array("w", "v")).alias("v")).where("u < v").distinct()
        edges = shared_table(small, "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    leaves = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    roots = edges.select("u").distinct().select(F.col("u").alias("node"), F.col("u").alias("component"))
    return leaves.unionByName(roots)
