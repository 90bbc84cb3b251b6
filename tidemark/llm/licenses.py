"""Licence recognition by sentences and rules.

A text is cut into sentences twice, with line ends as ends of sentences (one-line
notices) and as white space (wrapped licence texts). Sentences that have a word of the
trade are normalised and mapped to the identifiers of all known licence sentences in
them, the specific before the general; the sequence of identifiers of a text is then
matched against licence rules in their order. A rule takes the identifiers it matches
out of the sequence, so a general rule does not find again what a specific one has
found; identifiers in a rule's gaps stay for other rules.

Expressions only: one pass over the texts, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier and pattern of known licence sentences, normalised
#: (lower case, single spaces, no punctuation), the more specific first. Short names
#: and versions are whole words, so that ``gpl 300`` or ``cc by design`` is neither.
SENTENCES = [
    ("ap", r"licensed under the apache license version 2 0|apache license version 2 0|apache( software)? license 2 0|licen[cs]ed under (the )?apache( software)? ?2 0|spdx license identifier apache 2 0"),
    ("ax", r"you may not use (this|the) file except in compliance with the license"),
    ("ay", r"you may obtain a copy of the license at"),
    ("az", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("am", r"\bmit licen[cs]ed?( mit)?\b|\blicen[cs]e (is )?mit\b|licen[cs]ed under (the )?mit\b|spdx license identifier mit\b"),
    ("mp", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mn", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mw", r"the software is provided as is without warranty of any kind"),
    ("ml", r"in no event shall the (authors|copyright holders|authors or copyright holders) be liable"),
    ("is", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted|\bisc licen[cs]e\b|spdx license identifier isc\b"),
    ("iw", r"the software is provided as is and the author disclaims all warranties"),
    ("ag", r"gnu affero general public licen[cs]e|\bagpl ?v?3?( 0)?( only| or later)?\b"),
    ("lg", r"gnu (lesser|library) general public licen[cs]e|\blgpl ?v?[23]?( [01])?( only| or later)?\b"),
    ("gl", r"gnu general public licen[cs]e( as published by the free software foundation)?( either)?( version| v) ?[23]( 0)? (or|of the license or) (at your option )?(any )?later( version)?\b|\bgpl( version)? ?v?[23]( 0)? or( any)? later( version)?\b"),
    ("g3", r"gnu general public licen[cs]e( version| v) ?3( 0)?\b|\bgpl ?v?3( 0)?( only)?\b"),
    ("g2", r"gnu general public licen[cs]e( version| v) ?2( 0)?\b|\bgpl ?v?2( 0)?( only)?\b"),
    ("gp", r"gnu general public licen[cs]e|\bgnu gpl\b|\bgpl (software|licen[cs]ed?)\b"),
    ("mz", r"mozilla public licen[cs]e( version| v)? ?2 0|spdx license identifier mpl 2 0|\bmpl 2 0\b"),
    ("m1", r"mozilla public licen[cs]e( version| v)? ?1 1|spdx license identifier mpl 1 1|\bmpl 1 1\b"),
    ("bo", r"boost software licen[cs]e( version 1 0)?|spdx license identifier bsl 1 0|\bbsl 1 0\b"),
    ("zl", r"\bzlib licen[cs]e\b|spdx license identifier zlib\b|altered source versions must be plainly marked as such"),
    ("ep", r"eclipse public licen[cs]e( version| v)? ?2 0|spdx license identifier epl 2 0|\bepl 2 0\b"),
    ("br", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bs", r"redistributions of source code must retain the above copyright notice"),
    ("bb", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bn", r"neither the name of [^<]* may be used to endorse or promote products"),
    ("bw", r"this software is provided by [^<]* as is and any express or implied warranties"),
    ("b3", r"\b(3 clause bsd|bsd 3 clause)( licen[cs]e)?\b|\b(new|modified|revised) bsd licen[cs]e\b"),
    ("b2", r"\b(2 clause bsd|bsd 2 clause)( licen[cs]e)?\b|\b(simplified bsd|freebsd) licen[cs]e\b"),
    ("bd", r"\bbsd licen[cs]e[ds]?\b|licen[cs]ed under (the )?bsd\b"),
    ("cz", r"\bcc0\b|creative commons zero"),
    ("cs", r"\bcc by nc sa\b|creative commons attribution non ?commercial share ?alike"),
    ("cd", r"\bcc by nc nd\b|creative commons attribution non ?commercial no ?deriv"),
    ("cn", r"\bcc by nc\b|creative commons attribution non ?commercial"),
    ("ca", r"\bcc by sa\b|creative commons attribution share ?alike"),
    ("cr", r"\bcc by nd\b|creative commons attribution no ?deriv"),
    ("cc", r"\bcc by( [0-9] [0-9]\b| licen[cs]e\b| international\b|$)|creative commons attribution"),
    ("ul", r"this is free and unencumbered software released into the public domain|spdx license identifier unlicense\b"),
    ("ar", r"all rights reserved"),
    ("co", r"^copyright (c )?([0-9]{4}|by )"),
]

#: A word of every known sentence, as it may stand before normalisation.
GAP = "[^a-z0-9]+"
NEEDED = (
    "(?i)licen[cs]|copyright|permission|redistribut|warrant|liab|endorse|gpl|cc0|unencumbered|mpl|epl|bsd|bsl|source versions|"
    + "|".join(x.replace(" ", GAP) for x in ("public domain", "as is", "all rights", "cc by", "creative commons", "general public"))
)

#: Licence and the sequence of identifiers that shows it, in order of
#: precedence. ``~`` lets any other identifiers lie between.
RULES = [
    ("MIT", "mp~mn~mw"),
    ("BSD-3-Clause", "br~bs~bb~bn"),
    ("BSD-2-Clause", "br~bs~bb"),
    ("ISC", "is~iw"),
    ("ISC", "is"),
    ("Apache-2.0", "ap~ax~ay"),
    ("Apache-2.0", "ap"),
    ("MIT", "am"),
    ("AGPL", "ag"),
    ("LGPL", "lg"),
    ("GPL-or-later", "gl"),
    ("GPL-3.0", "g3"),
    ("GPL-2.0", "g2"),
    ("GPL", "gp"),
    ("MPL-2.0", "mz"),
    ("MPL-1.1", "m1"),
    ("BSL-1.0", "bo"),
    ("Zlib", "zl"),
    ("EPL-2.0", "ep"),
    ("BSD-3-Clause", "b3"),
    ("BSD-2-Clause", "b2"),
    ("BSD", "bd"),
    ("CC0-1.0", "cz"),
    ("CC-BY-NC-SA", "cs"),
    ("CC-BY-NC-ND", "cd"),
    ("CC-BY-NC", "cn"),
    ("CC-BY-SA", "ca"),
    ("CC-BY-ND", "cr"),
    ("CC-BY", "cc"),
    ("Unlicense", "ul"),
    ("Proprietary", "co~ar"),
    ("Proprietary", "ar"),
]

#: Licences that a line end can cut out of a more specific one; then wrapped text decides.
GENERAL = {"GPL": ("gl", "g3", "g2"), "GPL-3.0": ("gl",), "GPL-2.0": ("gl",), "BSD": ("b3", "b2"), "CC-BY": ("cs", "cd", "cn", "ca", "cr"), "CC-BY-NC": ("cs", "cd")}

#: Ends of sentences; a semicolon is none, since licence sentences go on behind it.
LINE_ENDS = r"[.!?]+[\x20\x09-\x0D]+|\n+"
STOP_ENDS = r"[.!?]+[\x20\x09-\x0D]+|\n[\x20\x09]*\n+"
#: A version and a plus sign: that version or a later one.
PLUS = "([0-9])[+]([^0-9a-z+]|$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A gap of a rule: other identifiers, as few as there are.
GAPS = "((?:<[a-z0-9]{2}>)*?)"


def rule_pattern(rule: str) -> str:
    """A rule over a sequence written ``<id><id>...``; its groups are the gaps."""
    return GAPS.join(f"<{x}>" for x in rule.split("~"))


def rule_gaps(rule: str, mark: str) -> str:
    """What stays of a match: the identifiers in its gaps."""
    return "".join(f"{mark}{n}" for n in range(1, rule.count("~") + 1))


def _normalised(sentence: Column) -> Column:
    lowered = F.regexp_replace(F.translate(sentence, UPPER, LOWER), PLUS, "$1 or later$2")
    return F.btrim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))


def _identifiers(sentence: Column) -> Column:
    """All known sentences in one sentence, in their order: a match gives way to its mark."""
    for name, pattern in SENTENCES:
        sentence = F.regexp_replace(sentence, pattern, f"<{name}>")
    return F.array_distinct(F.regexp_extract_all(sentence, F.lit("<[a-z0-9]{2}>"), F.lit(0)))


def identifiers(text: Column, ends: str) -> tuple[Column, Column]:
    """The known sentences of a text as ``<id><id>...``, and how many sentences of the trade are unknown."""
    some = F.filter(F.split(text, ends), lambda s: s.rlike(NEEDED))
    found = F.transform(F.transform(some, _normalised), _identifiers)
    return F.array_join(F.flatten(found), ""), F.size(F.filter(found, lambda x: F.size(x) == 0)).cast("long")


def _specific(name: str) -> Column:
    """Whether the text without its line ends shows a licence more specific than ``name``."""
    return F.col("b").rlike("|".join(f"<{x}>" for x in GENERAL[name])) if name in GENERAL else F.lit(False)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_sentences, n_unknown, sentences, licenses`` per row.

    ``sentences`` are the identifiers found with line ends as ends of sentences, then
    (after ``|``) those with line ends as white space; ``n_sentences`` is the larger
    number of the two and ``n_unknown`` the number of lines' sentences with a word of the
    trade that are none known. ``licenses`` are the licences that either shows, in
    alphabetical order, joined by commas (empty: none). Null and empty texts have none.
    Texts are read whole; repeated rows give repeated rows; an empty table gives an empty
    result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.select(F.col(id_col), F.when(text.rlike(NEEDED), text).otherwise("").alias("__text"))
    a, unknown = identifiers(F.col("__text"), LINE_ENDS)
    held = held.select(F.col(id_col), a.alias("a"), unknown.alias("n_unknown"), identifiers(F.col("__text"), STOP_ENDS)[0].alias("b"))
    for i, (name, rule) in enumerate(RULES):
        pattern = rule_pattern(rule)
        a, b = ("a", "b") if i == 0 else (f"a{i - 1}", f"b{i - 1}")
        held = held.select(
            "*", ((F.col(a).rlike(pattern) & ~_specific(name)) | F.col(b).rlike(pattern)).alias(f"hit{i}"),
            F.regexp_replace(a, pattern, rule_gaps(rule, "$")).alias(f"a{i}"),
            F.regexp_replace(b, pattern, rule_gaps(rule, "$")).alias(f"b{i}"),
        )
    names = F.array(*[F.when(F.col(f"hit{i}"), F.lit(name)) for i, (name, _) in enumerate(RULES)])
    licenses = F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull()))), ",")
    return held.select(
        F.col(id_col),
        F.greatest(F.length("a") / 4, F.length("b") / 4).cast("long").alias("n_sentences"),
        "n_unknown",
        F.concat("a", F.lit("|"), "b").alias("sentences"),
        licenses.alias("licenses"),
    )


def licenses_sql() -> str:
    """The same rules and sentences in DuckDB's SQL."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    marked = "s"
    for name, pattern in SENTENCES:
        marked = f"regexp_replace({marked}, {quoted(pattern)}, '<{name}>', 'g')"
    found = f"regexp_extract_all({marked}, '<[a-z0-9]{{2}}>')"

    def ids(ends: str) -> str:
        some = f"list_filter(string_split_regex(t, {quoted(ends)}), lambda s: regexp_matches(s, {quoted(NEEDED)}))"
        lowered = f"regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '{PLUS}', '\\1 or later\\2', 'g')"
        plain = f"trim(regexp_replace({lowered}, '[^a-z0-9]+', ' ', 'g'))"
        own = f"list_transform(list_transform({some}, lambda s: {plain}), lambda s: {found})"
        return f"list_transform({own}, lambda l: list_filter(l, lambda x, i: list_position(l, x) = i))"

    steps = [
        f"c AS (SELECT doc_id, {ids(LINE_ENDS)} AS a, {ids(STOP_ENDS)} AS b FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))",
        "s0 AS (SELECT doc_id, len(list_filter(a, lambda x: len(x) = 0)) AS n_unknown, array_to_string(flatten(a), '') AS a, array_to_string(flatten(b), '') AS b FROM c)",
    ]
    a, b = "a", "b"
    for i, (name, rule) in enumerate(RULES):
        p, rest = quoted(rule_pattern(rule)), quoted(rule_gaps(rule, "\\"))
        less = f"NOT regexp_matches(b, '{'|'.join(f'<{x}>' for x in GENERAL[name])}')" if name in GENERAL else "true"
        steps.append(
            f"s{i + 1} AS (SELECT *, (regexp_matches({a}, {p}) AND {less}) OR regexp_matches({b}, {p}) AS hit{i}, "
            f"regexp_replace({a}, {p}, {rest}, 'g') AS a{i}, regexp_replace({b}, {p}, {rest}, 'g') AS b{i} FROM s{i})"
        )
        a, b = f"a{i}", f"b{i}"
    names = ", ".join(f"CASE WHEN hit{i} THEN '{n}' END" for i, (n, _) in enumerate(RULES))
    return (
        f"WITH {', '.join(steps)} SELECT doc_id, (greatest(length(a), length(b)) // 4)::BIGINT AS n_sentences, n_unknown::BIGINT AS n_unknown, a || '|' || b AS sentences, "
        f"array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))), ',') AS licenses FROM s{len(RULES)}"
    )
