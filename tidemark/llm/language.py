"""Language identification in two steps: the family first, then the languages within it.

Texts are vectors of hashed character 1-, 2- and 3-grams (square roots of counts, length
1) of the whole lower-cased text, letters and single spaces only. A linear support
vector machine a family (that family against the rest) picks the family; within it, one
a pair of languages votes (one versus one), which sees only the differences that
matter between related languages. The machines are trained in tasks, one a problem, on
a bounded sample of the labelled rows, and are small enough to go with every task that
predicts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.mixing import uniform
from tidemark.llm.shared import shared_table

#: Languages of a family. A language that is in none is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "celtic": "br cy ga gd",
}
FAMILY_OF = {language: family for family, languages in FAMILIES.items() for language in languages.split()}
DIM = 1 << 13
CHUNK = 1 << 20
#: Rows a machine is trained on, at most about; half of them of one language of a pair.
TRAIN_ROWS = 2000
#: Languages learned, those with most labelled rows.
MOST_LANGUAGES = 256
COST, EPOCHS = 1.0, 20
UNKNOWN = "und"

_SPACED = np.arange(256, dtype=np.uint32)
_SPACED[:128] = [c if 97 <= c <= 122 else 32 for c in range(128)]


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of a whole text, ``CHUNK`` characters at a time."""
    counts = np.zeros(DIM, np.int64)
    tail = np.array([32], np.uint32)
    for at in range(0, len(text), CHUNK):
        x = _SPACED[np.frombuffer(text[at : at + CHUNK].lower().encode("utf-8", "replace"), np.uint8)]
        x = np.concatenate([tail, x])
        fresh = np.ones(len(x), bool)
        fresh[1:] = (x[1:] != 32) | (x[:-1] != 32)
        fresh[: len(tail)] = True
        old, x = len(tail), x[fresh]
        grams = [x[old:], x[1:] + (x[:-1] << 8), x[2:] + (x[1:-1] << 8) + (x[:-2] << 16)]
        for n, g in enumerate(grams):
            g = g[max(0, old - n) :] if n else g
            hashed = (g + np.uint32(n * 0x5BD1E995)) * np.uint32(2654435761) >> np.uint32(32 - DIM.bit_length() + 1)
            counts += np.bincount(hashed, minlength=DIM)
        tail = x[-2:]
    return counts


def vector(text: str) -> np.ndarray:
    v = np.sqrt(gram_counts(text)).astype(np.float32)
    length = float(np.linalg.norm(v))
    return v / length if length else v


def train(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A linear support vector machine (squared hinge loss) by dual coordinate descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w, alpha, slack = np.zeros(x.shape[1]), np.zeros(len(x)), 1 / (2 * COST)
    norms = (x * x).sum(1) + slack
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        most = 0.0
        for i in order.permutation(len(x)):
            gradient = y[i] * (w @ x[i]) - 1 + slack * alpha[i]
            step = min(gradient, 0.0) if alpha[i] == 0 else gradient
            most = max(most, abs(step))
            if step:
                new = max(alpha[i] - gradient / norms[i], 0.0)
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if most < 1e-3:
            break
    return w.astype(np.float32)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [vector(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("language"), batch.column("u"), pa.array(made, pa.binary())], names=["language", "u", "v"])


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["u", "sign", "v"])  # the same machine, however rows arrive
    x = np.stack([np.frombuffer(v, np.float32) for v in rows["v"]])
    return pd.DataFrame({"machine": rows["machine"].iloc[:1].to_list(), "weights": [train(x, rows["sign"].to_numpy(np.float64)).tobytes()]})


def family(language: str) -> str:
    return FAMILY_OF.get(language, f"only {language}")


def learn(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[dict[tuple, np.ndarray], list[str]]:
    """Machines and languages from ``labelled(id, text, language)``, none of them null.

    Machines are ``(family,)`` against the other families and ``(a, b)`` for two languages
    of one family, where ``a < b`` is positive. Sampling is by a hash of the id, so
    reruns learn the same; each language gives about half of ``train_rows`` to its pairs,
    each family its share to the families' machines. With no more than one language
    there is nothing to tell apart.
    """
    counts = labelled.groupBy("language").count().orderBy(F.desc("count"), "language").limit(MOST_LANGUAGES).collect()
    n = {r.language: r["count"] for r in counts}
    families: dict[str, list[str]] = {}
    for language in sorted(n):
        families.setdefault(family(language), []).append(language)
    share = train_rows // max(2, len(families))
    rate = {x: min(1.0, train_rows / 2 / n[x]) for x in n}
    family_rate = {x: share / sum(n[y] for y in families[family(x)]) for x in n}
    machines: list[tuple] = []
    roles = []  # (machine, sign, language, up to which u)
    for f in families if len(families) > 1 else ():
        roles += [(len(machines), 1 if family(x) == f else -1, x, family_rate[x]) for x in n]
        machines.append((f,))
    for of in families.values():
        for a, b in combinations(of, 2):
            roles += [(len(machines), 1, a, rate[a]), (len(machines), -1, b, rate[b])]
            machines.append((a, b))
    if not machines:
        return {}, sorted(n)
    wanted = F.create_map(*[F.lit(v) for x in n for v in (x, max(rate[x], family_rate[x]))])
    sample = labelled.withColumn("u", uniform(F.col("id"), seed=23)).where(F.col("u") < wanted[F.col("language")])
    sample = sample.where(F.col("text").rlike(r"\p{L}")).select("language", "u", "text")
    sample = shared_table(sample.mapInArrow(_vectors, "language string, u double, v binary"), "language-sample")
    plan = labelled.sparkSession.createDataFrame(roles, "machine int, sign int, language string, upto double")
    rows = sample.join(F.broadcast(plan), "language").where("u < upto").select("machine", "sign", "u", "v")
    trained = rows.groupBy("machine").applyInPandas(_train, "machine int, weights binary").collect()
    return {machines[r.machine]: np.frombuffer(r.weights, np.float32) for r in trained}, sorted(n)


def decide(x: np.ndarray, machines: dict[tuple, np.ndarray], languages: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages and scores of vectors: the family of the largest margin, then most votes, then largest margins."""
    squash = lambda m: 1 / (1 + np.exp(-np.clip(2.0 * m, -30, 30)))
    groups: dict[str, list[str]] = {}
    for language in languages:
        groups.setdefault(family(language), []).append(language)
    names = sorted(groups)
    margins = np.stack([x @ machines[f,][:-1] + machines[f,][-1] if (f,) in machines else np.full(len(x), -9.0) for f in names], 1)
    best = margins.argmax(1) if len(names) > 1 else np.zeros(len(x), int)
    score = np.ones(len(x))
    if len(names) > 1:
        ordered = np.sort(margins, 1)
        score = squash((ordered[:, -1] - ordered[:, -2]) / 2)
    found = np.array(["" for _ in range(len(x))], object)
    for k, f in enumerate(names):
        mine, of = np.flatnonzero(best == k), groups[f]
        if not len(mine):
            continue
        votes, sums, sure = (np.zeros((len(mine), len(of))) for _ in range(3))
        for i, j in combinations(range(len(of)), 2):
            w = machines.get((of[i], of[j]))
            m = x[mine] @ w[:-1] + w[-1] if w is not None else np.zeros(len(mine))
            votes[:, i], votes[:, j] = votes[:, i] + (m >= 0), votes[:, j] + (m < 0)
            sums[:, i], sums[:, j] = sums[:, i] + m, sums[:, j] - m
            sure[:, i], sure[:, j] = sure[:, i] + squash(m), sure[:, j] + squash(-m)
        winner = (votes + 0.5 * np.tanh(sums) / len(of)).argmax(1)
        found[mine] = np.array(of, object)[winner]
        if len(of) > 1:
            score[mine] *= sure[np.arange(len(mine)), winner] / (len(of) - 1)
    return found.tolist(), score


def _predict(batches: Iterator[pa.RecordBatch], machines: dict[tuple, np.ndarray], languages: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n = batch.column("_text"), batch.num_rows
        answers, scores = [UNKNOWN] * n, np.zeros(n)
        spoken = [i for i, ok in enumerate(batch.column("_spoken").to_pylist()) if ok] if languages else []
        for at in range(0, len(spoken), 256):
            rows = spoken[at : at + 256]
            found, score = decide(np.stack([vector(texts[i].as_py()) for i in rows]), machines, languages)
            for i, language, s in zip(rows, found, score):
                answers[i], scores[i] = language, s
        keep = [c for c in batch.schema.names if c not in ("_text", "_spoken")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(answers, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])


def held_out(id_column: Column) -> Column:
    """Whether the CRC-32 of the id leaves 1 divided by 3; false for null."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` a row of ``docs``, repeated rows included.

    Learned from rows with id and language that are not held out; predicted from the text
    alone. Null texts and texts without a letter are ``und`` with score 0, and so is
    everything where no row is labelled. Texts of any length are read whole. Other
    columns are ignored; an empty table gives no rows.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").cast("string").alias("language"))
    out = held_out(F.col("doc_id"))
    labelled = narrow.where(F.col("language").isNotNull() & F.col("doc_id").isNotNull() & ~out)
    known = labelled.select(F.col("doc_id").alias("id"), F.col("_text").alias("text"), "language").where("text is not null")
    machines, languages = learn(known, train_rows)
    rows = narrow.select("doc_id", out.alias("held_out"), "_text", F.coalesce(F.col("_text").rlike(r"\p{L}"), F.lit(False)).alias("_spoken"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(lambda b: _predict(b, machines, languages), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
