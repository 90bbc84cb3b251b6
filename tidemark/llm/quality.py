"""Quality rules: line-first cleaning.

Each line is judged alone: a line fails if it is navigation (mostly menu separators
or links), boilerplate (a notice of the site rather than of the text) or wrong in its
punctuation: as many symbols as words, or no end of a sentence, at its end or within, in a line
too long for a heading. Words of menus and notices are those of four languages. Failing lines are removed,
and a document that loses too much of its text is rejected. Base measures of the
whole text come first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 50
HEADING_WORDS = 12

MARKS = re.compile(rb"[|>]|\xc2\xbb|\xe2\x80\xa2")
#: Words of menus and of site notices in English, German, French and Spanish.
MENU_WORDS = (
    "home|login|log in|sign in|sign up|register|menu|next|previous|back to top|share|tweet|subscribe|"
    "startseite|anmelden|abmelden|registrieren|menü|weiter|zurück|nach oben|teilen|abonnieren|"
    "accueil|connexion|inscription|suivant|précédent|haut de page|partager|s'abonner|"
    "inicio|iniciar sesión|registrarse|menú|siguiente|anterior|volver arriba|compartir|suscribirse"
)
NOTICES = (
    r"cookie|javascript|terms of (use|service)|privacy policy|all rights reserved|click here|lorem ipsum|copyright \d{4}|"
    "nutzungsbedingungen|datenschutzerklärung|alle rechte vorbehalten|hier klicken|impressum|"
    "conditions d'utilisation|politique de confidentialité|tous droits réservés|cliquez ici|mentions légales|"
    "términos (de uso|y condiciones)|política de privacidad|todos los derechos reservados|haga clic aquí|aviso legal"
)
NAVIGATION = re.compile(rb"(?i)(?<![\w\x80-\xff])(" + MENU_WORDS.encode() + rb")(?![\w\x80-\xff])")
BOILERPLATE = re.compile(rb"(?i)(" + NOTICES.encode() + rb")")
ENDS = tuple(x.encode() for x in (*".!?:;\"')", "…", "”", "“", "’", "»", "。", "！", "？", "؟", "।"))
SENTENCE_END = re.compile(rb"[.!?](\s|$)|" + "…|。|！|？|؟|।".encode())


def line_verdict(line: bytes, words: list[bytes]) -> str:
    """``keep`` or the rule that a line with words fails."""
    marks = len(MARKS.findall(line))
    if marks >= 2 and 4 * marks >= len(words):
        return "navigation"
    if len(words) <= HEADING_WORDS and 2 * len(NAVIGATION.findall(line)) >= len(words):
        return "navigation"
    if len(words) <= 2 * HEADING_WORDS and BOILERPLATE.search(line):
        return "boilerplate"
    if len(line) - len(line.translate(None, SYMBOLS)) >= max(3, len(words)):
        return "punctuation"
    if len(words) > HEADING_WORDS and not line.rstrip().endswith(ENDS) and not SENTENCE_END.search(line):
        return "punctuation"
    return "keep"


def repeated_words(words: list[bytes], width: int = REPEAT_WINDOW) -> int:
    """Words inside a ``width``-word window that occurs twice or more in ``words``."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + code[k : k + n] + np.uint64(1)
            mixed ^= mixed >> np.uint64(29)
    _, which, counts = np.unique(mixed, return_inverse=True, return_counts=True)
    suspects = np.nonzero(counts[which] > 1)[0]
    if not len(suspects):
        return 0
    seen: dict[tuple, int] = {}  # equal hashes are compared as words
    for at in suspects.tolist():
        window = tuple(words[at : at + width])
        seen[window] = seen.get(window, 0) + 1
    covered = np.zeros(len(words) + 1, np.int64)
    for at in suspects.tolist():
        if seen[tuple(words[at : at + width])] > 1:
            covered[at] += 1
            covered[at + width] -= 1
    return int((np.cumsum(covered[:-1]) > 0).sum())


def judge(text: bytes | None) -> tuple:
    """The values of ``FIELDS`` for one text."""
    text = text or b""
    words = text.split()  # bytes: exactly the white space \x20 and \x09-\x0D
    solid = b"".join(words)
    word_chars = len(solid.decode("utf-8", "replace"))
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    seen, dup_lines, kept, lost = set(), 0, [], {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            kept.append(line)
            continue
        if line in seen:
            dup_lines += 1
        seen.add(line)
        rule = line_verdict(line, own)
        if rule == "keep":
            kept.append(line)
        else:
            lost[rule] += len(own)
    repeats = repeated_words(words)
    base_failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    gone = sum(lost.values())
    keep = not base_failed and 100 * gone <= MAX_LOST_PERCENT * len(words)
    return (
        len(words), word_chars, symbols, dup_lines, repeats, base_failed, keep,
        lost["punctuation"], lost["navigation"], lost["boilerplate"], b"\n".join(kept),
    )


FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lost_punctuation", pa.int64()),
    ("lost_navigation", pa.int64()), ("lost_boilerplate", pa.int64()), ("cleaned", pa.binary()),
]
VERDICT_TYPE = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, lost_punctuation long, lost_navigation long, lost_boilerplate long"
)


def _runner(text_at: int, cleaned: bool):
    """Rows with their texts cleaned, or the other columns with the verdict alone."""
    fields = FIELDS if cleaned else FIELDS[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            columns = list(zip(*map(judge, texts))) if texts else [()] * len(FIELDS)
            new = [pa.array(c, type=t) for c, (_, t) in zip(columns, fields)]
            if cleaned:  # texts that lose nothing stay as they are, null included
                lost = zip(texts, columns[7], columns[8], columns[9], columns[10])
                text = pa.array([t if a + b + c == 0 else x for t, a, b, c, x in lost], type=pa.binary())
                new[-1] = text.cast(pa.string())
            names = [n for n, _ in fields]
            held = [i for i in range(batch.num_columns) if cleaned or i != text_at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in held], *new], names=[*[batch.schema.names[i] for i in held], *names])

    return run


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict of each row: ``id_col`` and the fields of ``VERDICT_TYPE``.

    ``base_failed`` is fewer than 20 words, or more than 30% of the words in 8-word
    windows that repeat. ``kept`` is false then, or if over half of the words are in
    lines that fail a rule. Null, empty and blank texts have no words and fail the
    base. Repeated rows are judged alike; an empty table gives an empty result.
    Other columns are ignored.
    """
    narrow = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text"))
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(_runner(1, False), f"`{id_col}` {kind}, {VERDICT_TYPE}")


def clean_by_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without rejected rows, failing lines removed from ``text_col``.

    All columns of ``docs`` come back unchanged otherwise, whatever their names.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    out = plain.mapInArrow(_runner(columns.index(text_col), True), f"{schema}, {VERDICT_TYPE}, cleaned string").where("kept")
    text_at = f"c{columns.index(text_col)}"
    return out.select(*[F.col("cleaned" if c == text_at else c).alias(n) for c, n in zip(plain.columns, columns)])
