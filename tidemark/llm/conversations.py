"""A trie of conversations by partition refinement.

Equal conversations are one sequence with a weight. All sequences start in one class
(the root); turn by turn a class splits by its members' next turns. A class that is
left with one sequence retires: the rest of that sequence is a chain of nodes without
branches, written from its own turns and split no further. A round splits the turns of
one band, from the first turn alone up to bands of 1024 turns, so that rounds are as
many as the logarithm of the longest beginning that two sequences share.

A class is known by the exclusive or of hashes of (place, turn) over its turns, 128 bits
of role and text, so a beginning takes no more room than a turn. Its members' smallest
conversation owns it; what a sequence owns is the end of its path, a chain. Folding
back, each chain's total goes to the classes that its sequence runs through, by one
aggregation, and a class leaves out what its owner has above it.

Turns are numbered by ranges of all turns, and running sums go by blocks: no long
conversation, common turn or large group of copies is brought to one task. Only the
hash of the ids that end at a node is made in order, from texts of up to 4096 ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import parallelism, shared_table, with_ranks
from tidemark.llm.sql import crc32_sql

HUNDRED, HEADS = 100, 6
BAND_BITS, ID_BITS = 10, 12
NO_ENDS = sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, a, b, n)``: turns from 1 in order, content hashes, code points of the text.

    Null turns come first; turns of one number are ordered by role and then by hashes of
    role and text. Rows without ``conv_id`` belong to no conversation and are left out.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), text, role).alias("b"), F.char_length(text).cast("long").alias("n"),
    )
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("a").asc(), F.col("b").asc()]
    return with_ranks(turns, order, ("conv_id",)).select("conv_id", (F.col("rank") + 1).alias("pos"), "a", "b", "n")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns ``(c, d, f1, f2, n)`` of rebuilt conversations, and all their ids ``(c)``.

    Conversation ``c`` begins with the first ``crc32(c) % 6`` turns of ``c - c % 100`` (as
    many as there are) and goes on with its own turns after as many.
    """
    spread = lambda c: F.crc32(c.cast("string").cast("binary")) % HEADS
    base = lambda c: c - c % HUNDRED
    c = F.col("conv_id")
    heads = turns.where((c % HUNDRED == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "base")
    lengths = heads.groupBy("base").agg(F.max("pos").alias("length")).withColumnRenamed("base", "of")
    ids = turns.where("pos = 1").select(c.alias("c"))
    begin = ids.join(heads, (base(F.col("c")) == F.col("base")) & (F.col("pos") <= spread(F.col("c"))))
    begin = begin.select("c", F.col("pos").alias("d"), "a", "b", "n")
    own = turns.where(F.col("pos") > spread(c)).join(lengths, base(c) == F.col("of"), "left")
    shift = spread(c) - F.least(spread(c), F.coalesce(F.col("length"), F.lit(0)))
    own = own.select(c.alias("c"), (F.col("pos") - shift).alias("d"), "a", "b", "n")
    rows = begin.unionByName(own)
    return rows.select("c", "d", F.xxhash64("d", "a", "b").alias("f1"), F.xxhash64(F.lit(2), "b", "a", "d").alias("f2"), "n"), ids


def band_of(d: Column) -> Column:
    """0 for turn 1, 1 for 2 and 3, 2 for 4 to 7, up to 512 to 1023; then one each 1024 turns."""
    high = (F.shiftright(d, BAND_BITS) + BAND_BITS - 1).cast("int")
    return F.when(d < (1 << BAND_BITS), F.floor(F.log2(d)).cast("int")).otherwise(high)


def band_end(band: int) -> int:
    return (2 << band) - 1 if band < BAND_BITS else ((band - BAND_BITS + 2) << BAND_BITS) - 1


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each sequence's ids, from texts of some that come sorted."""
    current, digest = None, None
    for batch in batches:
        done = []
        for s, part in zip(batch.column("s").to_pylist(), batch.column("part").to_pylist()):
            if s == current:
                digest.update(b"," + part.encode())
                continue
            if current is not None:
                done.append((current, digest.hexdigest()))
            current, digest = s, sha256(part.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int64(), pa.string()))], names=["s", "ends"])
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([digest.hexdigest()])], names=["s", "ends"])


def ends_of_groups(members: DataFrame, sequences: DataFrame) -> DataFrame:
    """``(s, ends)`` for sequences of several conversations."""
    keys = [members[k].eqNullSafe(sequences[k]) for k in ("f1", "f2", "length")]
    many = members.join(sequences, keys[0] & keys[1] & keys[2]).select("s", "c", F.shiftright("c", ID_BITS).alias("block"))
    parts = many.groupBy("s", "block").agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("part"))
    parts = parts.repartition(parallelism(members.sparkSession), "s").sortWithinPartitions("s", "block")
    return parts.select("s", "part").mapInArrow(_ends, "s long, ends string")


def refine(paths: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes by turns, in rounds: the rows ``(s, d, p1, p2)`` looked at, and the classes.

    ``paths(s, d, f1, f2, n, m, length, band)`` are stored by band. Classes have ``d, p1,
    p2``, their parent's ``u1, u2``, ``q`` sequences, ``n_convs``, their ``owner`` and ``n``.
    """
    zero = F.lit(0).cast("long")
    active = sequences.select("s", zero.alias("x1"), zero.alias("x2"), "length")
    rows_of, classes_of, band = [], [], 0
    while not active.isEmpty():
        so_far = Window.partitionBy("s").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        here = paths.where((F.col("folder") == min(band, BAND_BITS)) & (F.col("band") == band)).drop("length").join(active, "s")
        here = here.select("s", "d", "f1", "f2", "n", "m", "length", *[F.col(f"x{k}").bitwiseXOR(F.bit_xor(f"f{k}").over(so_far)).alias(f"p{k}") for k in (1, 2)])
        rows = shared_table(here, "trie-rows")
        classes = rows.groupBy("d", "p1", "p2").agg(
            F.min("f1").alias("f1"), F.min("f2").alias("f2"), F.count("*").alias("q"), F.sum("m").alias("n_convs"), F.min("s").alias("owner"), F.min("n").alias("n")
        )
        classes = classes.select("*", F.col("p1").bitwiseXOR(F.col("f1")).alias("u1"), F.col("p2").bitwiseXOR(F.col("f2")).alias("u2")).drop("f1", "f2")
        classes = shared_table(classes, "trie-classes")
        retired = classes.where("q = 1").select(F.col("owner").alias("s")).distinct()
        last = rows.where((F.col("d") == band_end(band)) & (F.col("length") > band_end(band)))
        active = shared_table(last.join(retired, "s", "left_anti").select("s", F.col("p1").alias("x1"), F.col("p2").alias("x2"), "length"), "trie-active")
        rows_of.append(rows)
        classes_of.append(classes)
        band += 1
    rows, classes = rows_of[0], classes_of[0]
    for more, others in zip(rows_of[1:], classes_of[1:]):
        rows, classes = rows.unionByName(more), classes.unionByName(others)
    return rows, classes


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; a conversation of no turns (all of them replaced by
    those of an absent one) ends at the root. Repeated rows are turns of their own. An
    empty table has no root and gives no rows. Other columns are ignored. See
    ``numbered_turns`` for ties.
    """
    spark = conversations.sparkSession
    turns = shared_table(numbered_turns(conversations), "trie-turns")
    rows, ids = rebuild(turns)
    rows = shared_table(rows, "trie-rebuilt")
    whole = rows.groupBy("c").agg(F.bit_xor("f1").alias("f1"), F.bit_xor("f2").alias("f2"), F.max("d").alias("length"))
    members = ids.join(whole, "c", "left").select("c", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("f1", "f2", "length")])
    members = shared_table(members, "trie-members")
    sequences = shared_table(members.groupBy("f1", "f2", "length").agg(F.min("c").alias("s"), F.count("*").alias("m")), "trie-sequences")
    root = sequences.agg(F.min("s").alias("owner"), F.sum("m").alias("n_convs")).first()
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if root["owner"] is None:
        return spark.createDataFrame([], schema)
    groups = shared_table(ends_of_groups(members, sequences.where("m > 1")), "trie-ends")

    mine = sequences.select(F.col("s").alias("c"), "s", "m", "length")
    paths = rows.join(mine, "c").drop("c").withColumn("band", band_of(F.col("d")))
    paths = paths.withColumn("folder", F.least("band", F.lit(BAND_BITS)))
    paths = shared_table(paths, "trie-paths", by="folder")
    rows, classes = refine(paths, sequences)

    # each class meets its parent; chains of retired sequences begin where a parent is shared
    shared = classes.where("q > 1")
    parent = shared.select((F.col("d") + 1).alias("d"), F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("owner").alias("parent_conv_id"))
    linked = classes.where("d > 1").join(parent, ["d", "u1", "u2"])
    first = classes.where("d = 1").withColumn("parent_conv_id", F.lit(root["owner"]))
    linked = shared_table(linked.unionByName(first), "trie-linked")
    n_children = linked.groupBy((F.col("d") - 1).alias("d"), F.col("u1").alias("p1"), F.col("u2").alias("p2")).agg(F.count("*").alias("n_children"))

    begins = linked.where("q = 1").select(F.col("owner").alias("s"), F.col("d").alias("begin"), "parent_conv_id")
    chains = shared_table(paths.join(begins, "s").where("d >= begin").drop("f1", "f2", "band", "folder"), "trie-chains")

    # fold back: what each sequence owns, summed over the sequences of a class
    worth = (F.col("n_convs") - 1) * F.col("n")
    total = shared.select(F.col("owner").alias("s"), worth.alias("own"), F.lit(0).alias("leaf"))
    total = total.unionByName(chains.select("s", ((F.col("m") - 1) * F.col("n")).alias("own"), (F.col("d") == F.col("length")).cast("int").alias("leaf")))
    total = shared_table(total.groupBy("s").agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf")), "trie-totals")
    through = rows.join(begins.select("s", "begin"), "s", "left").where("begin is null or d < begin").drop("begin")
    sums = through.join(total, "s").groupBy("d", "p1", "p2").agg(F.sum("own").alias("own"), F.sum("leaf").alias("n_leaves"))
    above = Window.partitionBy("owner").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    nodes = linked.where("q > 1").withColumn("above", F.coalesce(F.sum(worth).over(above), F.lit(0)))

    own_end = F.when(F.col("m") == 1, F.sha2(F.col("s").cast("string"), 256)).otherwise(F.col("ends"))
    ends = through.where("d = length").select("d", "p1", "p2", "s", "m").join(groups, "s", "left").select("d", "p1", "p2", own_end.alias("ends_sha256"))
    key = ["d", "p1", "p2"]
    nodes = nodes.join(sums, key).join(n_children, key, "left").join(ends, key, "left").select(
        F.col("owner").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves", (F.col("own") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )

    chains = chains.join(groups, "s", "left").withColumn("ends_sha256", F.when(F.col("d") == F.col("length"), own_end).otherwise(F.lit(NO_ENDS)))
    chains = chains.drop("ends").withColumn("block", F.shiftright("d", BAND_BITS)).withColumn("own", (F.col("m") - 1) * F.col("n"))
    many = chains.where("m > 1")
    blocks = many.groupBy("s", "block").agg(F.sum("own").alias("after"))
    later = Window.partitionBy("s").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("after", F.coalesce(F.sum("after").over(later), F.lit(0)))
    rest = Window.partitionBy("s", "block").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    many = many.withColumn("inside", F.sum("own").over(rest)).join(blocks, ["s", "block"])
    many = many.withColumn("saved_tokens", F.col("inside") + F.col("after")).drop("inside", "after")
    chains = many.unionByName(chains.where("m = 1").withColumn("saved_tokens", F.lit(0).cast("long"))).select(
        F.col("s").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("begin"), F.col("parent_conv_id")).otherwise(F.col("s")).alias("parent_conv_id"),
        F.col("m").alias("n_convs"), (F.col("d") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "saved_tokens", "ends_sha256",
    )

    everything = total.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("saved"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves"))
    children = linked.where("d = 1").agg(F.count("*").alias("n_children"))
    turnless = sequences.where("length = 0").join(groups, "s", "left").agg(F.max(own_end).alias("ends"))
    top = everything.crossJoin(children).crossJoin(turnless).select(
        F.lit(root["owner"]).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(root["n_convs"]).alias("n_convs"), "n_children", F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.col("saved").cast("long").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return nodes.unionByName(chains).unionByName(top)


TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
m AS (
  SELECT c, c - c % 100 AS base, {crc32_sql("c::VARCHAR")} % 6 AS h, (SELECT count(*) FROM t WHERE t.conv_id = c - c % 100) AS n_base
  FROM (SELECT DISTINCT conv_id AS c FROM t)),
r AS (
  SELECT c, pos AS d, role, text FROM m JOIN t ON t.conv_id = m.base AND pos <= h
  UNION ALL
  SELECT c, pos - h + least(h, n_base), role, text FROM m JOIN t ON t.conv_id = c AND pos > h),
p AS (
  SELECT c, d, length(text) AS n, sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d)) AS node FROM r
  UNION ALL SELECT c, 0, 0, '' FROM m),
q AS (SELECT *, max(d) OVER (PARTITION BY c) AS len, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent FROM p),
nodes AS (
  SELECT node, any_value(d) AS depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS own,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = d), '')) AS ends_sha256
  FROM q GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT DISTINCT x.node, y.node AS sub FROM p x JOIN p y ON x.c = y.c AND y.d >= x.d),
sums AS (
  SELECT b.node, sum(n.own) AS saved, count(*) FILTER (k.node IS NULL) AS n_leaves
  FROM below b JOIN nodes n ON n.node = b.sub LEFT JOIN kids k ON k.node = b.sub GROUP BY b.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       s.n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN kids k ON k.node = n.node LEFT JOIN nodes u ON u.node = n.parent
"""
