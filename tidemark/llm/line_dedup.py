"""Removal of repeated runs of lines, by winnowing.

Lines with text are hashed; of each window of ``run_lines`` lines the least hash (the
leftmost of equals) is a fingerprint. Equal windows choose the same line, so two runs of
``run_lines`` or more equal lines share the fingerprint of every window. Only the chosen
positions travel, each with the ``run_lines - 1`` line hashes before and after it.

Positions of one fingerprint are joined pairwise where it occurs up to ``JOINED`` times:
a match is extended to both sides line by line and deletes the later place's lines if
``run_lines`` or more agree. A fingerprint that occurs more often (a common line) is told
apart by whole windows: those that hold it are grouped by their lines, and each is
compared with the first place in the corpus that has it. Both delete the same runs.

Everything is DataFrame operations. First places are minima with partial aggregation,
so a common line costs a task one row a window, and joined groups are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_table

RUN_LINES = 3
JOINED = 16  # positions of a fingerprint that are joined pairwise; more are told apart by windows
BLANKS = " \t\x0b\x0c\r"
NO_ID = (1 << 63) - 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _with_text(lines: Column) -> Column:
    """(at, line) of the lines that are not blank, without white space around them."""
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("at"), F.btrim(line, F.lit(BLANKS)).alias("line")))
    return F.filter(numbered, lambda x: x["line"] != "")


def _word_count(line: Column) -> Column:
    return F.size(F.split(line, r"[\x20\x09-\x0D]+"))


def _own_lines(docs: DataFrame, least_lines: int) -> DataFrame:
    """Documents of ``least_lines`` lines with text or more: their lines, hashes and word counts."""
    own = docs.select("doc_id", "mark", _with_text(_lines(F.col("text"))).alias("own")).where(F.size("own") >= least_lines)
    own = own.select("doc_id", "mark", F.transform("own", lambda x: x["line"]).alias("line"))
    return own.withColumn("h", F.transform("line", lambda x: F.xxhash64(x)))


def _positions(docs: DataFrame, run_lines: int) -> DataFrame:
    """Each window's least hash: its document, place and the line hashes around it."""
    own = _own_lines(docs, run_lines).drop("line")
    own = own.withColumn("hashed", F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    starts = F.sequence(F.lit(0), F.size("h") - run_lines)
    chosen = F.array_distinct(F.transform(starts, lambda s: F.array_min(F.slice("hashed", s + 1, run_lines))))
    rows = own.select("doc_id", "mark", "h", F.explode(chosen).alias("c"))
    at, around = F.col("c.at"), run_lines - 1
    left = F.slice("h", F.greatest(at - around, F.lit(0)) + 1, F.least(at, F.lit(around)))
    return rows.select("doc_id", "mark", F.col("c.h").alias("print"), at.alias("at"), left.alias("left"), F.slice("h", at + 2, around).alias("right"))


def _short_windows(docs: DataFrame, run_lines: int, long_words: int) -> DataFrame:
    """Windows of fewer than ``run_lines`` lines that hold ``long_words``: place, size and 128 bits over the lines."""
    own = _own_lines(docs, 1).withColumn("words", F.transform("line", _word_count)).drop("line")

    def windows(size: int) -> Column:
        starts = F.when(F.size("h") >= size, F.sequence(F.lit(0), F.size("h") - size)).otherwise(F.array().cast("array<int>"))
        long = F.filter(starts, lambda s: F.aggregate(F.slice("words", s + 1, size), F.lit(0), lambda a, n: a + n) >= long_words)
        return F.transform(long, lambda s: _window(F.slice("h", s + 1, size), s.cast("int"), size))

    return own.select("doc_id", "mark", F.explode(F.concat(*map(windows, range(1, run_lines)))).alias("w")).select("doc_id", "mark", "w.*")


def _window(hashes: Column, start: Column, size: int) -> Column:
    return F.struct(F.lit(size).alias("size"), start.alias("start"), F.xxhash64(F.lit(1), hashes).alias("k1"), F.xxhash64(F.lit(2), hashes).alias("k2"))


def _extended(a: Column, b: Column, sign: int, most: int) -> Column:
    """How many hashes of two arrays agree, from their ends (``sign`` -1) or beginnings on."""
    reach = F.lit(0)
    for n in range(1, most + 1):
        same = F.try_element_at(a, F.lit(sign * n)) == F.try_element_at(b, F.lit(sign * n))
        reach = F.when((reach == n - 1) & same, n).otherwise(reach)
    return reach


def _joined(positions: DataFrame, run_lines: int) -> DataFrame:
    """``doc_id, mark, line`` of later places among the few positions of each fingerprint."""
    place = F.struct("doc_id", "mark", "at", "left", "right")
    groups = positions.groupBy("print").agg(F.array_sort(F.collect_list(place)).alias("own"))

    def lost(later: Column, n: Column) -> Column:
        """Lines of the ``n``-th place (from 0) that it shares with an earlier one."""

        def lines(earlier: Column) -> Column:
            before = _extended(earlier["left"], later["left"], -1, run_lines - 1)
            after = _extended(earlier["right"], later["right"], 1, run_lines - 1)
            same = (earlier["doc_id"] == later["doc_id"]) & (earlier["mark"] == later["mark"])
            apart = ~same | (later["at"] - earlier["at"] >= run_lines)
            none = F.array().cast("array<int>")
            return F.when(apart & (before + after + 1 >= run_lines), F.sequence(later["at"] - before, later["at"] + after)).otherwise(none)

        return F.struct(later["doc_id"].alias("doc_id"), later["mark"].alias("mark"), F.array_distinct(F.flatten(F.transform(F.slice("own", 1, n), lines))).alias("lines"))

    found = groups.select(F.explode(F.transform("own", lost)).alias("x")).select("x.*")
    return found.select("doc_id", "mark", F.explode("lines").alias("line"))


def _grouped(windows: DataFrame) -> DataFrame:
    """``doc_id, mark, line`` of windows whose lines are at an earlier place."""
    first = windows.groupBy("size", "k1", "k2").agg(F.min(F.struct("doc_id", "mark", "start")).alias("first"), F.count("*").alias("n"))
    first = shared_table(first.where("n > 1").select("size", "k1", "k2", "first"), "line-first")
    same = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    later = ~same | (F.col("start") - F.col("first.start") >= F.col("size"))
    hits = windows.join(first, ["size", "k1", "k2"]).where(later)
    return hits.select("doc_id", "mark", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("line"))


def repeated_lines(docs: DataFrame, run_lines: int = RUN_LINES, long_words: int | None = None) -> DataFrame:
    """``(doc_id, mark, gone)`` for ``docs(doc_id, mark, text)`` that lose lines.

    ``gone`` numbers the lines to delete among the lines with text, from 0.
    """
    positions = shared_table(_positions(docs, run_lines), "line-positions")
    place = F.struct("doc_id", "mark", "at")
    prints = positions.groupBy("print").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n"))
    prints = shared_table(prints.where("low <> high").select("print", (F.col("n") > JOINED).alias("common")), "line-prints")
    again = shared_table(positions.join(prints, "print"), "line-again")
    lines = _joined(again.where("not common"), run_lines)

    context = F.concat("left", F.array("print"), "right")
    starts = F.sequence(F.lit(0), F.size("context") - run_lines)
    common = again.where("common").select("doc_id", "mark", (F.col("at") - F.size("left")).alias("begin"), context.alias("context"))
    windows = common.select("doc_id", "mark", F.explode(F.transform(starts, lambda s: _window(F.slice("context", s + 1, run_lines), F.col("begin") + s, run_lines))).alias("w"))
    windows = windows.select("doc_id", "mark", "w.*")
    if long_words is not None:
        windows = windows.unionByName(_short_windows(docs, run_lines, long_words))
    lines = lines.unionByName(_grouped(shared_table(windows, "line-windows")))
    return lines.groupBy("doc_id", "mark").agg(F.collect_set("line").alias("gone"))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_lines: int = RUN_LINES, report: bool = False,
    long_words: int | None = None,
) -> DataFrame:
    """``docs`` with later repeats of runs of ``run_lines`` or more lines deleted.

    A line is compared without the white space around it; blank lines stay and do not
    break a run. With ``long_words`` runs of fewer lines go too if they hold so many
    words, however few lines their document has. A run is later if its window of lines occurs in a
    document with a smaller id, or before in the same document without overlapping
    (the second of two adjacent copies goes). A null id is larger than any other; of
    rows with one id and different texts a hash of the text decides, and rows that
    repeat both are one document: they lose the same lines and not each other's.
    Null texts stay null, documents without repeats stay as they are, and a document
    that loses all its lines has an empty text (or its blank lines). An empty table
    gives an empty result.

    All columns come back, whatever their names. With ``report`` the columns are
    ``id_col, n_lines`` (lines with text), ``n_removed`` and ``text_col`` instead.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    key, text = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"
    doc_id, mark = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("mark")
    narrow = docs.select(F.col(id_col).alias(key), F.col(text_col).alias(text)).select(doc_id, mark, F.col(text).alias("text"))
    gone = repeated_lines(narrow, run_lines, long_words)

    joined = plain.select("*", doc_id, mark).join(gone, ["doc_id", "mark"], "left")
    joined = joined.withColumn("lines", _lines(F.col(text)))
    at = F.transform(_with_text(F.col("lines")), lambda x: x["at"])
    joined = joined.withColumn("at", F.when(F.col("gone").isNotNull(), at))
    dropped = F.transform("gone", lambda n: F.element_at("at", n + 1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), dropped)
    cleaned = F.array_join(F.transform(kept, lambda i: F.element_at("lines", i + 1)), "\n")
    joined = joined.withColumn("cleaned", F.when(F.col("gone").isNull(), F.col(text)).otherwise(cleaned))
    if report:
        return joined.select(
            F.col(key).alias(id_col), F.size(_with_text(F.col("lines"))).cast("long").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.col("cleaned").alias(text_col),
        )
    return joined.select(*[F.col("cleaned" if c == text else c).alias(n) for c, n in zip(plain.columns, columns)])


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, n, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)
), own AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM lines WHERE line <> ''
), windows AS (
  SELECT doc_id, r, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS w
  FROM own WINDOW d AS (PARTITION BY doc_id ORDER BY r)
), placed AS (
  SELECT doc_id, r, first_value(doc_id) OVER f AS first_doc, first_value(r) OVER f AS first_r
  FROM windows WHERE w IS NOT NULL WINDOW f AS (PARTITION BY w ORDER BY doc_id, r)
), gone AS (
  SELECT DISTINCT doc_id, r + unnest([0, 1, 2]) AS r FROM placed WHERE doc_id <> first_doc OR r - first_r >= 3
), counts AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
ranks AS (
  SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM lines WHERE line <> ''
), kept AS (
  SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.n) AS text, count(r.r) AS n_lines
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents) l
  LEFT JOIN ranks r ON r.doc_id = l.doc_id AND r.n = l.n
  LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.r = r.r
  WHERE g.doc_id IS NULL GROUP BY l.doc_id
), totals AS (SELECT doc_id, count(*) AS n_lines FROM own GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0)::BIGINT AS n_lines, coalesce(c.n_removed, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN c.n_removed IS NULL THEN coalesce(d.text, '') ELSE coalesce(k.text, '') END) AS kept_sha256
FROM documents d LEFT JOIN totals t USING (doc_id) LEFT JOIN counts c USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
