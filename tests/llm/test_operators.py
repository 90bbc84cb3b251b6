"""Each operator against brute force: the driver's small table, and rows made to be awkward."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_whole import alike, without_long_lines
from tidemark.llm import components, exact_dedup, licenses, line_dedup, mixing, pieces, quality, queries, shared, simhash, substring_dedup, token_counts, url_filter

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa Lambda MU été 漢字 ∑um".split()


def awkward() -> list[tuple]:
    """(doc_id, text, source): nulls, blanks, copies, shared passages, one long text."""
    rng = random.Random(5)

    def prose(n: int) -> str:
        out = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)]
        return " ".join(w + ("\n" if rng.random() < 0.1 else "") for w in out)

    passage, copy, lines = prose(60), prose(80), "one line here\nanother line there\n\na third line now"
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, copy, "b"), (5, copy, "b"), (6, copy + " end", "b"), (7, prose(30000), "c")]
    rows += [(10 + i, f"{prose(5)}\n{lines}\n{prose(10)} {passage} {prose(15)}", "a" if i % 3 else "d") for i in range(8)]
    rows += [(30, "a b c " * 30, "b"), (31, "word " * 13, "b"), (32, "x\ny\nz\nx\ny\nz", None), (33, "x\ny\nz", "é")]
    rows += [(40, "tab\tsep\x0bvt\x0cff\r\nnl\u00a0nbsp\u2003em", "z"), (41, "Released under the MIT License.", "z"), (42, "<s> </s> <|endoftext|> ▁ \x00 \u0301e", "z")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """The awkward rows, with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(awkward(), "doc_id long, text string, source string")
    return df.withColumn("size", F.lit("s")).withColumn("mark", F.lit(1)).withColumn("kept", F.lit(True)).withColumn("ids", F.lit(2.5)).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def small(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


def rows_of(df) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def by_id(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, str(r[0]), str(r)))


@pytest.mark.parametrize("which", ["docs", "small"])
def test_exact_dedup(which, request):
    df = request.getfixturevalue(which)
    got = exact_dedup.exact_dedup(df, bucket_bytes=2000, block_bytes=3000).collect()
    assert by_id((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == by_id(brute.exact(rows_of(df)))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_dedup_chains_collisions(docs):
    got = exact_dedup.exact_dedup(docs, key_bits=1).select("doc_id", "keep_id", "group_size", "text_sha256").collect()
    assert by_id(got) == by_id(brute.exact(rows_of(docs)))


def test_exact_dedup_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(df).collect()
    assert sum(r.kept for r in got) == 2 and sorted(r.group_size for r in got) == [1, 3, 3, 3]


def test_directory_doubles_until_buckets_fit():
    cells = {0: 5, 1: 5, 2: 5, 12: 100}
    directory = exact_dedup.split_directory(cells, 4, 10)
    sizes: dict[int, int] = {}
    for c, n in cells.items():
        sizes[directory[c]] = sizes.get(directory[c], 0) + n
    assert directory == sorted(directory) and all(n <= 10 or n == 100 for n in sizes.values())


@pytest.mark.parametrize(("which", "joined"), [("docs", 16), ("docs", 0), ("docs", 1000), ("small", 16), ("small", 3)])
def test_line_dedup(which, joined, request, monkeypatch):
    """All by windows, all by joined positions, and both: the same lines go."""
    monkeypatch.setattr(line_dedup, "JOINED", joined)
    df = request.getfixturevalue(which)
    want = brute.line_runs(rows_of(df))
    got = line_dedup.line_dedup(df, report=True).collect()
    assert by_id(got) == by_id(want)
    assert sum(r[2] for r in want) > 0
    assert line_dedup.line_dedup(df).columns == df.columns


def test_line_dedup_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc\nd"), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in line_dedup.line_dedup(df).collect()}
    assert got == {(1, "a\nb\nc"), (None, "d"), (2, None)}


@pytest.mark.parametrize("which", ["docs", "small"])
def test_quality_rules(which, request):
    df = request.getfixturevalue(which)
    got = quality.quality_rules(df).collect()
    base = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]
    assert by_id(base) == by_id((i, *brute.quality(t)) for i, t in rows_of(df))
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_cleans_lines_first(spark):
    prose = "This is a line of plain prose with many words that ends as it should.\n" * 1 + "Another one of these follows here with other words, and ends well too."
    bad = "\nHome | News | Sport | Weather | Login\nAll rights reserved.\n"
    df = spark.createDataFrame([(1, prose + bad), (2, bad * 9), (3, None)], "doc_id long, text string")
    got = quality.clean_by_lines(df).collect()
    assert [(r.doc_id, r.text.strip()) for r in got] == [(1, prose)]


def test_quality_rules_in_four_languages():
    long = b"words without any end of a sentence in a line that is too long for a heading"
    verdicts = {
        "Startseite Anmelden Menü": "navigation", "Accueil Connexion": "navigation", "Inicio Iniciar sesión": "navigation", "Alle Rechte vorbehalten": "boilerplate",
        "Tous droits réservés": "boilerplate", "Todos los derechos reservados": "boilerplate", "Weiterhin": "keep", "Der Weg führt weiter nach Norden.": "keep",
    }
    for line, want in verdicts.items():
        assert quality.line_verdict(line.encode(), line.encode().split()) == want, line
    assert quality.line_verdict(long, long.split()) == "punctuation"
    wrapped = b"end of one. " + long  # text that is wrapped in the middle of a sentence
    assert quality.line_verdict(wrapped, wrapped.split()) == "keep"


@pytest.mark.parametrize("which", ["docs", "small"])
def test_token_counts(which, request):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    library = Tokenizer.from_file(public_tokenizers.path(queries.WORD_VOCABULARY))
    library.no_truncation()
    library.no_padding()
    want = []
    for i, t in rows_of(df):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    got = token_counts.count_tokens(df, public_tokenizers.path(queries.WORD_VOCABULARY)).collect()
    assert by_id(got) == by_id(want)


@pytest.mark.parametrize("which", ["docs", "small"])
def test_pieces(which, request):
    import sentencepiece

    df = request.getfixturevalue(which)
    path = public_tokenizers.path(queries.PIECE_MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for i, t in rows_of(df):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, np.array(ids, "<u4").tobytes(), library.decode(ids)))
    coded = pieces.encode_documents(df, path, ids="token_ids")
    assert by_id((r.doc_id, bytes(r.token_ids), r.decoded) for r in coded.select("doc_id", "token_ids", "decoded").collect()) == by_id(want)


@pytest.mark.parametrize(("which", "width", "group", "block"), [("docs", 13, None, 4_000_000), ("docs", 13, 1, 300), ("docs", 5, 2, 1000), ("small", 13, 20, 20_000)])
def test_remove_repeats(which, width, group, block, request):
    df = request.getfixturevalue(which)
    got = substring_dedup.remove_repeats(df, width=width, group=group, block_words=block).collect()
    want = brute.repeats(rows_of(df), width)
    assert by_id((r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept.encode())) for r in got) == by_id(want)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)


def test_remove_repeats_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (None, "x " + text)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    assert got == [(0, 20), (0, 20), (5, 0), (5, 0)]


def test_subtree_finds_least_document_of_each_window():
    common = [substring_dedup.shared_words(a, b) for a, b in zip([b"a ", b"a b ", b"a b c ", b"ab "], [b"a b ", b"a b c ", b"ab ", b"b "])]
    assert common == [1, 2, 0, 0]
    assert list(substring_dedup.internal_nodes(common)) == [(2, 1, 2), (1, 0, 2)]
    group = {b"a b c d": [4, 4], b"x a b c": [2, 2], b"q r s": [1, 1]}
    assert dict(substring_dedup.subtree(group, 3)) == {b"a b c d": [2, 4]}


@pytest.mark.parametrize("which", ["docs", "small"])
def test_simhash(which, request):
    df = request.getfixturevalue(which)
    got = simhash.simhash_components(df).select("doc_id", "fingerprint", "component_id").collect()
    assert by_id(got) == by_id(brute.components(rows_of(df)))


def test_simhash_links_dense_groups(spark, monkeypatch):
    """Fingerprints around a few centres, with the run limit so low that runs are split."""
    monkeypatch.setattr(simhash, "RUN_LIMIT", 3)
    rng = np.random.default_rng(1)
    prints = set()
    for centre in rng.integers(0, 1 << 63, 5, dtype=np.uint64).tolist():
        for _ in range(60):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            prints.add(x - ((x >> 63) << 64))
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    got = {r.node: r.component for r in components.connected_components(simhash.simhash_links(df)).collect()}
    values = np.array(sorted(prints), np.int64)
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values.view(np.uint64) ^ values.view(np.uint64)[i]) <= 3).tolist():
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    want = {int(values[i]): int(values[root(i)]) for i in range(len(values))}
    assert {k: got.get(k, k) for k in want} == want


def test_one_of_each_group(docs):
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute.components(rows_of(docs))}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select((F.col("id") * 7919 % 201).alias("u"), ((F.col("id") + 1) * 7919 % 201).alias("v")).repartition(5)
    got = components.connected_components(edges).collect()
    assert len(got) == 201 and {r.component for r in got} == {0}


def test_mixing(docs, small):
    for df in (docs, small):
        rows = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
        sizes: dict = {}
        for _, t, s in rows:
            sizes[s] = sizes.get(s, 0) + len(brute.words(t))
        want = brute.targets(sizes)
        got = mixing.mix_sources(df).collect()
        assert got and sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(5)).collect()))
        taken = dict.fromkeys(sizes, 0)
        largest = dict.fromkeys(sizes, 0)
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
            assert r.taken <= 3 * r["size"] and (r.taken % r["size"] == 0 if r["size"] else r.taken == 0)
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r["size"])
        assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)


def test_mix_prefers_quality(spark):
    df = spark.createDataFrame([(i, "a b c d", "s" if i % 2 else "t") for i in range(4000)], "doc_id long, text string, source string")
    weights = df.select("doc_id", F.when(F.col("doc_id") % 4 < 2, 9.0).otherwise(1.0).alias("quality_weight"))
    got = mixing.mix_sources(df, weights).where("source = 't' and taken > 0").groupBy("quality_weight").count().collect()
    counts = {r.quality_weight: r["count"] for r in got}
    assert counts[9.0] > 1.5 * counts[1.0]


def test_mix_selection_against_sorted_keys(docs, small):
    """Whole epochs, then the shortest prefix of each source's rows in key order."""
    for df in (docs, small):
        weight = mixing.text_quality(F.col("text"))
        got = {(r.doc_id): r for r in mixing.mix_sources(df, weight=weight).collect()}
        keyed = df.select("doc_id", "source", mixing.draw_key(weight, F.col("doc_id"), seed=11).alias("k")).collect()
        for source in {r.source for r in keyed}:
            rows = sorted((r.k, r.doc_id) for r in keyed if r.source == source)
            size = {i: got[i]["size"] for _, i in rows}
            total, target = sum(size.values()), got[rows[0][1]].target
            epochs = int(target // max(total, 1))
            budget, start = target - epochs * total, 0
            for _, i in rows:
                chosen = start + size[i] / 2 <= budget and start < budget
                assert got[i].taken == size[i] * (epochs + chosen), (source, i)
                start += size[i]


def test_mix_small_and_odd_weights(spark):
    """Weights of any scale spread over many cells; none, zero or less do not fail."""
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    for scale in (1e-6, 1.0, 2e4):
        key = mixing.draw_key(F.lit(scale), F.col("doc_id"), seed=11)
        most = df.groupBy(mixing.cell_of(key).alias("c")).count().agg(F.max("count")).first()[0]
        assert most < 40
    odd = F.when(F.col("doc_id") % 4 == 0, 0.0).when(F.col("doc_id") % 4 == 1, -1.0).when(F.col("doc_id") % 4 == 2, F.lit(None)).otherwise(1.0)
    two = df.withColumn("source", F.when(F.col("doc_id") < 10000, "s").otherwise("t"))
    taken = mixing.mix_sources(two, weight=odd).where("source = 't' and taken > 0").select((F.col("doc_id") % 4).alias("m"))
    assert 5000 < taken.count() < 10000 and taken.where("m > 1").count() == 5000  # the rows of weight 1 first


def test_text_quality_ranks_prose_over_junk(spark):
    texts = ["one line of prose\nand another line", "same line\nsame line\nsame line", "### *** $$$ %%%", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", mixing.text_quality(F.col("text")).alias("w")).collect()
    w = {r.i: r.w for r in rows}
    assert w[0] == 1.0 and w[1] == pytest.approx(1 / 3) and w[2] < 0.2 and all(x > 0 for x in w.values())


def test_mix_rows_repeats_what_is_taken(docs):
    got = mixing.mix_rows(docs)
    assert got.columns == docs.columns
    weight = mixing.text_quality(F.col("text"))
    want = {r.doc_id: r.taken // r["size"] for r in mixing.mix_sources(docs, weight=weight).where("taken > 0").collect()}
    assert {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()} == want


def test_url_filter(spark, tables):
    urls = [
        None, "", "no scheme", "http://EXAMPLE.org/en/12", "https://a.b.example.org/es/x?y", "http://example.org", "http://org/", "ftp://notexample.org/es/",
        "http://x.com/fr/1#z", "http://x.com/frankly", "http://com/de/", "http://.com/de/?", "http://user@h.com:80/de/", "http://x.net/fr/", "a://b://c/d", "http:///org/",
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")

    def judge(url):
        rest = url.partition("://")[2] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        for c in "?#":
            path = path.partition(c)[0]
        fits = [(len(r), r, v) for r, v in url_filter.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_cascade_is_exact(spark):
    hosts = [f"h{i}.net" for i in range(3000)]
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(hosts)], "page_id long, url string")
    rules = spark.createDataFrame([(f"{h}/", "block") for h in hosts[::5]], "rule string, verdict string")
    got = {r.page_id for r in url_filter.filter_urls(pages, rules).where("verdict = 'block'").collect()}
    assert got == set(range(0, 3000, 5))


def test_licenses(spark, docs):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated files. The above copyright notice and this permission notice
shall be included in all copies. The software is provided "as is", without warranty of any kind."""
    texts = [mit, "Licensed under CC BY-NC 4.0.", "GNU General Public License, version 3.", "a licence to think", None, "Licensed under the Apache License, Version 2.0. All rights reserved."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(df).collect()}
    assert got == {0: "MIT", 1: "CC-BY-NC", 2: "GPL-3.0", 3: "", 4: "", 5: "Apache-2.0,Proprietary"}
    assert licenses.scan_licenses(docs).where("doc_id = 41").first().licenses == "MIT"


def test_empty_tables(empty, tmp_path):
    path, model = public_tokenizers.path(queries.WORD_VOCABULARY), public_tokenizers.path(queries.PIECE_MODEL)
    results = [
        exact_dedup.exact_dedup(empty), line_dedup.line_dedup(empty), quality.quality_rules(empty), quality.clean_by_lines(empty), token_counts.count_tokens(empty, path),
        pieces.encode_documents(empty, model, ids="token_ids"), substring_dedup.remove_repeats(empty), simhash.simhash_components(empty), simhash.one_of_each_group(empty),
        mixing.mix_sources(empty), mixing.mix_rows(empty), licenses.scan_licenses(empty),
    ]
    assert [df.count() for df in results] == [0] * len(results)


def test_pipeline_stages(spark, tables):
    """Every stage against brute force on what its predecessor kept."""
    import corpus_pipeline as cp
    import sentencepiece

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in cp.STAGES:
        before = docs
        docs = shared.shared_table(stage(spark, docs, tables), "stage")
        held[name] = (before, docs)
        if name != "encode":
            assert docs.columns == columns
    before, after = held["quality rules"]
    cleaned = {i: quality.judge(t.encode() if t else None) for i, t in rows_of(before)}
    assert {i: t for i, t in rows_of(after)} == {i: v[10].decode() for i, v in cleaned.items() if v[6]}
    before, after = held["line dedup"]
    want = {i: t for i, t in without_long_lines(rows_of(before)).items() if brute.words(t)}
    assert dict(rows_of(after)) == want
    long = [x.strip() for _, t in rows_of(after) for x in t.split("\n") if len(x.split()) >= 13]
    assert long and len(long) == len(set(long))
    before, after = held["near-duplicates"]
    assert {i for i, _ in rows_of(after)} == alike(rows_of(before))[0]
    assert not alike(rows_of(after))[1]
    before, after = held["mix"]
    weight = mixing.text_quality(F.col("text"))
    times = {r.doc_id: r.taken // r["size"] for r in mixing.mix_sources(before, weight=weight).where("taken > 0").collect()}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == times
    before, after = held["encode"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_MODEL))
    want = {i: np.array(library.encode(t, add_bos=True, add_eos=True), "<u4").tobytes() for i, t in rows_of(before)}
    assert {r.doc_id: bytes(r.ids) for r in after.collect()} == want and after.count() == before.count()
    assert cp.run(spark, tables).count() == after.count()
