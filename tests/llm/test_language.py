"""Language identification: held-out accuracy, and what it must not look at."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, queries
from tidemark.llm.queries import documents

COLUMNS = ["doc_id", "held_out", "lang_pred", "score"]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, "/root/testdata/sf0.01").cache()


@pytest.fixture(scope="module")
def found(docs):
    return {r.doc_id: r for r in language.identify_languages(docs).collect()}


def test_held_out_accuracy(docs, found):
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert set(found) == set(truth)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i].held_out == (i in set(held)) for i in truth) and len(held) > 300
    assert sum(found[i].lang_pred == truth[i] for i in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_labels_of_held_out_rows_source_and_order_do_not_matter(docs, found):
    """Held-out languages wrong, sources gone, rows elsewhere: the same predictions."""
    out = language.held_out(F.col("doc_id"))
    other = docs.withColumn("lang", F.when(out, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string")).repartition(7)
    got = {r.doc_id: r for r in language.identify_languages(other).collect()}
    assert all(got[i].lang_pred == found[i].lang_pred and got[i].score == pytest.approx(found[i].score) for i in found)


def test_predictions_by_hand(docs):
    """Families first, then pairs: the operator's answers from its machines, one text at a time."""
    known = docs.where(~language.held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("language"))
    machines, languages = language.learn(known)
    assert languages == ["de", "en", "es", "fr"] and set(machines) == {("germanic",), ("romance",), ("de", "en"), ("es", "fr")}
    got = {r.doc_id: r.lang_pred for r in language.identify_languages(docs).collect()}
    for r in docs.limit(100).collect():
        x = language.vector(r.text)
        margin = {m: float(w[:-1] @ x + w[-1]) for m, w in machines.items()}
        pair = ("de", "en") if margin["germanic",] > margin["romance",] else ("es", "fr")
        assert got[r.doc_id] == pair[0 if margin[pair] >= 0 else 1]


def test_nulls_letterless_long_repeated_and_clashing(spark, docs):
    base = docs.limit(300).select("doc_id", "text", "lang", "source")
    long = "und die der " * 200_000
    odd = spark.createDataFrame(
        [(None, "the and of that", "en", None), (10**12, None, "de", "s"), (10**12 + 1, "", "de", "s"), (10**12 + 2, "123 ... ", None, "s"), (10**12 + 3, long, None, "s"), (10**12 + 3, long, None, "s")], base.schema
    )
    df = base.unionByName(odd).withColumns({"_text": F.lit(1), "language": F.lit("zz"), "score": F.lit(2), "u": F.lit(0.0)})
    rows = language.identify_languages(df).collect()
    assert len(rows) == base.count() + 6 and list(rows[0].__fields__) == COLUMNS
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.held_out, r.lang_pred, r.score))
    assert all(by[10**12 + k] == [(zlib.crc32(str(10**12 + k).encode()) % 3 == 1, "und", 0.0)] for k in range(3))
    assert len(by[10**12 + 3]) == 2 and len(set(by[10**12 + 3])) == 1 and by[10**12 + 3][0][1] == "de"
    assert by[None][0][0] is False and by[None][0][1] == "en"


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify_languages(df).collect()} == {"und"}
    assert language.identify_languages(df.limit(0)).collect() == []
    one = spark.createDataFrame([(i, f"text {i}", "en") for i in range(30)], df.schema)
    assert {(r.lang_pred, r.score) for r in language.identify_languages(one).collect()} == {("en", 1.0)}


def test_three_families_and_a_language_without_one(spark):
    words = {"en": "the and of that with", "de": "und der die nicht ein", "es": "los que una para con", "qq": "zzu zzy xxk qqw vvk"}
    draw = np.random.default_rng(5)
    rows = [(i, " ".join(draw.choice(words[x].split(), 12)), x) for i, x in enumerate(list(words) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify_languages(df).collect()}
    assert all(got[i] == x for i, _, x in rows)


def test_grams_of_chunks_are_those_of_the_whole():
    text = "Ärger, im   Öl! 12 " * 100_000
    whole = language.gram_counts(text)
    old, language.CHUNK = language.CHUNK, 1000
    try:
        assert (language.gram_counts(text) == whole).all()
    finally:
        language.CHUNK = old
    assert whole.sum() > 0 and language.vector("...").sum() >= 0


def test_query(spark):
    assert queries.op11_language_id(spark, "/root/testdata/sf0.001").columns == COLUMNS
