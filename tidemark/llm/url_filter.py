"""URL rules looked up in Bloom filter cascades.

A rule is a host and the start of a path, such as ``example.org/en/``. A URL's keys
are its host and parent domains, each with the starts of its path that are as long
as some rule's. Level 0 of a cascade encodes the listed keys; level 1 those keys of
the corpus that level 0 takes wrongly; level 2 the listed keys that level 1 takes
wrongly, and so on until none is left. The first level without a key tells exactly,
for every key of the corpus, whether it is listed: no join and no false positive.

Level sizes follow the list, not the corpus: level 0 passes about as many unlisted
keys as there are listed ones, for log2(keys / listed) bits a listed key, and later
levels halve what is left. So the broadcast has a bound of a few bytes a rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_table

#: Each level halves the keys that are left; more levels than this cannot be chance.
MOST_LEVELS = 128
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or if there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def keys_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """Keys of a URL, longest first."""
    labels, at = [host], host.find(".")
    while at >= 0:
        labels.append(host[at + 1 :])
        at = host.find(".", at + 1)
    keys = {name + path[:n] for name in labels if name for n in lengths if n <= len(path)}
    return sorted(keys, key=lambda k: (-len(k), k))


class Level:
    def __init__(self, salt: int, n: int, rate: float):
        self.salt = salt
        self.bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(-math.log2(rate)))
        self.words = np.zeros((self.bits + 63) // 64, np.uint64)

    def positions(self, key: str) -> list[int]:
        a = xxhash.xxh64_intdigest(key, 2 * self.salt)
        b = xxhash.xxh64_intdigest(key, 2 * self.salt + 1) | 1
        return [(a + i * b) % (1 << 64) % self.bits for i in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(int(self.words[p >> 6]) >> (p & 63) & 1 for p in self.positions(key))


def listed(levels: list[Level], key: str) -> bool:
    for i, level in enumerate(levels):
        if key not in level:
            return i % 2 == 1
    return len(levels) % 2 == 1


def _fill(level: Level, keys: DataFrame) -> None:
    """Set the level's bits for ``keys(key)``; its words come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [p for k in batch.column("key").to_pylist() for p in level.positions(k)]
            bits = [(1 << (p & 63)) - ((p & 63 == 63) << 64) for p in at]
            yield pa.RecordBatch.from_arrays([pa.array([p >> 6 for p in at], pa.int64()), pa.array(bits, pa.int64())], names=["word", "bits"])

    words = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    for row in words.toLocalIterator():
        level.words[row.word] = row.bits & 0xFFFFFFFFFFFFFFFF


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([k in level for k in batch.column("key").to_pylist()], pa.bool_()))

    return keys.mapInArrow(run, "key string")


def build_cascade(keys: DataFrame, urls: DataFrame, lengths: list[int], universe: int) -> list[Level]:
    """Levels for the listed ``keys(key)`` over all keys of ``urls(host, path)``.

    ``universe`` is about the number of keys of the corpus; it sets sizes only.
    """
    count = keys.count()
    if not count:
        return []
    rate = min(0.5, max(2.0**-40, count * math.sqrt(0.5) / max(universe, 1)))
    level = Level(0, count, rate)
    _fill(level, keys)

    def wrong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {
                k for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())
                for k in keys_of(h, p, lengths) if k in level
            }
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["key"])

    others = urls.mapInArrow(wrong, "key string").distinct().join(keys, "key", "left_anti")
    levels, ours, theirs = [level], keys, shared_table(others, "url-keys")
    while n := theirs.count():
        if len(levels) == MOST_LEVELS:
            raise RuntimeError(f"{n} keys are left after {MOST_LEVELS} levels of a cascade")
        level = Level(len(levels), n, 0.5)
        _fill(level, theirs)
        levels.append(level)
        ours, theirs = theirs, shared_table(_passing(ours, level), "url-keys")
    return levels


def filter_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """``id_col, host, path, rule, verdict`` per row of ``pages``.

    ``rules(rule, verdict)`` holds ``host/path`` strings with a verdict each; of a rule
    given twice the least verdict holds. A rule fits its host and all subdomains if the
    URL's path starts with the rule's; the longest rule that fits wins, of equally long ones the first by code point. Without one,
    ``rule`` is null and the verdict ``default``: the URL is not listed. A null URL or
    one without ``://`` has an empty host and path and fits no rule. Repeated rows give
    repeated rows; empty tables (of pages or rules) are fine; other columns are ignored.
    """
    host, path = host_and_path(F.col(url_col))
    urls = shared_table(pages.select(F.col(id_col), host.alias("host"), path.alias("path")), "urls")
    rules = rules.where("rule is not null and verdict is not null").groupBy(F.col("rule").alias("key")).agg(F.min("verdict").alias("verdict"))
    rules = shared_table(rules, "url-rules")
    # distinct lengths of rule paths, not rules: bounded by the longest URL
    length = F.length("key") - F.instr("key", "/") + 1
    lengths = sorted(r.n for r in rules.where("instr(key, '/') > 0").select(length.alias("n")).distinct().collect())
    per_url = F.size(F.split("host", r"\.")) * F.lit(max(1, len(lengths)))
    universe = int(urls.select("host", "path").agg(F.sum(per_url)).first()[0] or 0)
    verdicts = sorted(r.verdict for r in rules.select("verdict").distinct().collect())
    cascades = [(v, build_cascade(rules.where(F.col("verdict") == v).select("key"), urls, lengths, universe)) for v in verdicts]
    sent = pages.sparkSession.sparkContext.broadcast(cascades)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rule, verdict = [], []
            for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                hits = ((k, v) for k in keys_of(h, p, lengths) for v, levels in sent.value if listed(levels, k))
                k, v = next(hits, (None, default))
                rule.append(k)
                verdict.append(v)
            arrays = [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "host", "path", "rule", "verdict"])

    kind = urls.schema[0].dataType.simpleString()
    return urls.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

URL_FILTER_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), m AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM h
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""
