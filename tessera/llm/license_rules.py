"""Licence scan by sentence rules, in built-in column functions only.

A text is cut into sentences (line ends, and ``. ! ? ; :`` before white space
or the end), each sentence is normalised (lower case, every run of other than
letters and digits one space) and looked up among the known licence sentences.
A sentence that is wrapped over lines is found too: from each line that starts a
known sentence, the lines after it are joined, up to a blank line or the end of
the sentence, and the longest known sentence that ends with a line or at
punctuation counts.  Comment leaders (``#``, ``*``, ``//``) are white space.
The identifiers found, in text order, are matched against the licence rules: a
rule is an ordered sequence of identifiers, which must follow each other with
at most ``max_gap`` unknown sentences between two of them (a wrapped one is
one, a bare list number such as ``1.`` none).  Rules are in order
of precedence: a match that overlaps a match of an earlier rule is dropped, so
a phrase inside a full licence isn't reported again.

Notices ("This work is licensed under the ...") are cut after their lead and the
licence name is looked up; an ``SPDX-License-Identifier`` is one sentence with
its value.

Everything happens within a row, so nothing is shuffled, whatever the sizes of
sources or of groups of copies.  Sentences and rules are literals of the plan;
their number is checked.

Sentence numbers and ``n_sentences`` count the pieces between all ends, line
ends too, as the SQL does; the SQL doesn't join lines, so it is a check for
texts without wrapped notices only; nor does it know the wordings of
``license_table``.

Cases: null and empty texts have no sentences and no licence; a word hyphenated
at a line end is not joined; repeated rows give repeated results; very long texts are scanned whole; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import license_table

# Sentences of public licences, normalised, by identifier.
SENTENCES = {
    "apache-ref": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "mit-ref": "released under the mit license",
    "mit-title": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files the software to deal in the software without restriction including "
                 "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                 "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                 "the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or "
                  "substantial portions of the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee "
                 "is hereby granted provided that the above copyright notice and this permission notice appear in "
                 "all copies",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software",
    "gpl3-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as "
                  "published by the free software foundation either version 3 of the license or at your option any "
                  "later version",
    "cc-by-nc-4-ref": "licensed under cc by nc 4 0",
    "cc-by-4-ref": "licensed under cc by 4 0",
    "cc-by-sa-4-ref": "licensed under cc by sa 4 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted "
                 "provided that the following conditions are met",
    "bsd-noendorse": "neither the name of the copyright holder nor the names of its contributors may be used to "
                     "endorse or promote products derived from this software without specific prior written "
                     "permission",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights": "all rights reserved",
}

# Licence and its ordered sentences; earlier rules go before later ones.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache-header", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-header", "apache-comply")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-terms")),
    ("BSD-3-Clause", ("all-rights", "bsd-grant", "bsd-noendorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-noendorse")),
    ("BSD-2-Clause", ("bsd-grant",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense",)),
    ("Apache-2.0", ("apache-ref",)),
    ("MIT", ("mit-ref",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-ref",)),
    ("CC-BY-4.0", ("cc-by-4-ref",)),
    ("LicenseRef-All-Rights-Reserved", ("all-rights",)),
)

#: What ``scan`` looks for: the above, which the SQL holds, and the wordings of ``license_table``.
ALL_SENTENCES = SENTENCES | license_table.SENTENCES
ALL_RULES = RULES + license_table.RULES + license_table.NAMED

#: Unknown sentences allowed between two sentences of a rule (numbered clauses, copyright lines).
MAX_GAP = 4
#: Sentences and rules are plan literals; larger sets are refused.
MAX_LITERALS = 2000

_END = r"[.!?;:]+([\x09-\x0D ]+|\z)|[\n\r]+"
_OTHER = r"[^\p{L}\p{N}\n]+"
_CUT = r" *\n *"


_NUMBER = r"^[0-9]{1,3}$"  # a list number that stands alone
_STOP = r"[.!?;:]+([\x09-\x0D ]+|\z)"
_LINE = r"\r\n?"
_PLUS = r"(spdx-license-identifier:[ \t]*[al]?gpl-[0-9.]+[0-9])\+"
_OPENS = r"^(this|the|it|dual|licensed|released|distributed|published|provided|available|made|covered)( |$)"


def _raw(text: Column) -> Column:
    """Normalised pieces of a text in order, with empty ones where a sentence or paragraph ends;
    between two others is a single line end."""
    later = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _PLUS, "$1-or-later")
    lines = F.regexp_replace(F.regexp_replace(later, _LINE, "\n"), _STOP, "\n\n")
    return F.split(F.trim(F.regexp_replace(lines, _OTHER, " ")), _CUT)


def _pieces() -> Column:
    """at (from 1), i (place in ``raw``), s, opens (starts a sentence, not a list number) of the pieces with words."""
    before = lambda i: F.get("raw", i - 1)
    some = F.filter(F.transform("raw", lambda s, i: F.struct(
        i.alias("i"), s.alias("s"),
        (((i == 0) | (before(i) == "")) & ~F.rlike(s, F.lit(_NUMBER))).alias("opens"))), lambda x: x["s"] != "")
    return F.transform(some, lambda x, i: F.struct((i + 1).alias("at"), x["i"], x["s"], x["opens"]))


def _literals(table: dict) -> list[tuple[str, str]]:
    return [(s, name) for name, some in table.items() for s in ((some,) if isinstance(some, str) else some)]


def _words(pairs: list[tuple[str, str]], more: int = 0) -> int:
    return max((s.count(" ") + 1 for s, _ in pairs), default=0) + more


def _map(pairs: list[tuple[str, str]]) -> Column:
    """Sentence to identifier, from one literal, so the plan stays small."""
    return F.str_to_map(F.lit("\n".join("\t".join(p) for p in pairs)), F.lit("\n"), F.lit("\t"))


def _list(pairs: list[tuple[str, str]]) -> Column:
    return F.split(F.lit("\n".join(s for s, _ in pairs)), "\n")


def _longest(pairs: list[tuple[str, str]], rest: Column, lead: Column) -> Column:
    """n (characters), s of the longest of ``pairs`` that follows ``lead`` in ``rest`` and ends with a line."""
    line = F.concat(F.translate(rest, "\n", " "), F.lit(" ")).substr(F.length(lead) + 1, F.length(rest) + 1)
    ends = F.concat(rest, F.lit("\n")).substr(F.length(lead) + 1, F.length(rest) + 1)
    once = F.array(F.struct(line.alias("line"), ends.alias("ends"), F.length(lead).alias("m")))  # not once a sentence

    def of(b):
        fits = F.filter(_list(pairs), lambda s: F.startswith(b["line"], F.concat(s, F.lit(" ")))
                        & (b["ends"].substr(F.length(s) + 1, F.lit(1)) == "\n"))
        return F.array_max(F.transform(fits, lambda s: F.struct((F.length(s) + b["m"]).alias("n"), s.alias("s"))))

    return F.get(F.transform(once, of), F.lit(0))


def _hits(pairs: list, names: list, tags: list) -> Column:
    """at, end (numbers of the first and last piece), id of the longest known sentence at each piece that has one."""
    text = lambda x, n: F.array_join(F.slice("raw", x["i"] + 1, n), "\n")
    tag = license_table.TAG

    def look(x):
        rest, short = text(x, _words(pairs)), text(x, _words(names, 20))  # a sentence of n words has at most n lines
        soft = F.coalesce(F.get("raw", x["i"] + 1), F.lit("")) != ""
        starts = F.exists(_list(pairs), lambda s: F.startswith(s, F.concat(x["s"], F.lit(" "))))
        lead = F.regexp_extract(F.translate(short, "\n", " "), license_table.LEAD, 0)
        name = F.when(F.contains(x["s"], F.lit(" under ")), F.regexp_extract(x["s"], license_table.LEAD + "(.+)$", 1))
        return F.struct(
            x["at"], F.element_at(_map(pairs), x["s"]).alias("id"), F.element_at(_map(names), name).alias("name"),
            F.when(x["s"] == tag, F.element_at(_map(tags), F.get("raw", x["i"] + 2))).alias("tag"),
            F.when(soft & starts, _longest(pairs, rest, F.lit(""))).alias("long"), x["i"],
            F.when(soft & F.rlike(x["s"], F.lit(_OPENS)), F.when(lead != "", _longest(names, short, lead))).alias("notice"))

    def hit(y):
        n = F.coalesce(y["long"]["n"], y["notice"]["n"])
        lines = F.regexp_count(text(y, _words(pairs)).substr(F.lit(1), n), F.lit("\n"))
        known = F.coalesce(F.element_at(_map(pairs), y["long"]["s"]), F.element_at(_map(names), y["notice"]["s"]))
        return F.struct(y["at"], (y["at"] + F.when(y["tag"].isNotNull(), 1).otherwise(F.coalesce(lines, F.lit(0)))).alias("end"),
                        F.coalesce(y["tag"], known, y["id"], y["name"]).alias("id"))

    some = F.filter(F.transform("pieces", look), lambda y: F.coalesce(
        y["id"], y["name"], y["tag"], y["long"]["s"], y["notice"]["s"]).isNotNull())
    return F.transform(some, hit)


def scan(docs: DataFrame, keep: list[str] = ("doc_id",), sentences: dict = ALL_SENTENCES, rules=ALL_RULES,
         max_gap: int = MAX_GAP, names: dict = license_table.NAMES, tags: dict = license_table.TAGS) -> DataFrame:
    """The ``keep`` columns, n_sentences, hits (first and last sentence number, identifier) and
    matches (rule number, licence, first and last sentence number)."""
    pairs = _literals(sentences)
    named = [(s, f"{name}-ref") for s, name in _literals(names)]
    tagged = [(s, f"{name}-tag") for s, name in tags.items()]
    if len(pairs) + len(named) + len(tagged) + len(rules) > MAX_LITERALS:
        raise ValueError(f"more than {MAX_LITERALS} sentences and rules")
    found = docs.select(*keep, _raw(F.col("text")).alias("raw")).select(*keep, "raw", _pieces().alias("pieces")).select(
        *keep, "pieces", F.size("pieces").alias("n_sentences"),
        _hits(pairs, named, tagged).alias("all_hits"))
    wide = F.filter("all_hits", lambda o: o["end"] > o["at"])
    found = found.withColumn("wide", wide).withColumn("hits", F.filter("all_hits", lambda h: ~F.exists(
        "wide", lambda o: (o["at"] <= h["at"]) & (h["end"] <= o["end"]) & (h["end"] - h["at"] < o["end"] - o["at"]))))
    table = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(name).alias("license"),
                               F.array(*map(F.lit, seq)).alias("ids")) for k, (name, seq) in enumerate(rules)])

    def of_rule(r):
        n = F.size(r["ids"])
        starts = F.when(F.size("hits") >= n, F.sequence(F.lit(1), F.size("hits") - n + 1)).otherwise(
            F.array().cast("array<int>"))
        at = lambda j: F.element_at("hits", j)["at"]
        end = lambda j: F.element_at("hits", j)["end"]

        def near(a, b):
            between = F.slice("pieces", end(a) + 1, F.greatest(at(b) - end(a) - 1, F.lit(0)))
            return (at(b) - end(a) - 1 <= max_gap) | (F.size(F.filter(between, lambda x: x["opens"])) <= max_gap)

        fits = F.filter(starts, lambda j: (F.slice(F.col("hits.id"), j, n) == r["ids"])
                        & F.forall(F.sequence(F.lit(1), n),
                                   lambda o: (o == 1) | near(F.greatest(j + o - 2, F.lit(1)), j + o - 1)))
        return F.transform(fits, lambda j: F.struct(r["rule"].alias("rule"), r["license"].alias("license"),
                                                    at(j).alias("first"), end(j + n - 1).alias("last")))

    every = F.when(F.size("hits") > 0, F.flatten(F.transform(table, of_rule)))
    kept = F.filter("every", lambda m: ~F.exists(
        "every", lambda o: (o["rule"] < m["rule"]) & (o["first"] <= m["last"]) & (m["first"] <= o["last"])))
    return found.withColumn("every", every).select(
        *keep, "n_sentences", "hits", F.coalesce(kept, F.slice("every", 1, 0)).alias("matches"))


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document, with lists as comma-joined text."""
    matches = F.array_sort("matches", lambda a, b: F.when(a["first"] < b["first"], -1).when(
        a["first"] > b["first"], 1).otherwise(a["rule"] - b["rule"]))
    return scan(docs, **options).withColumn("m", F.when(F.size("matches") > 0, matches)).select(
        "doc_id", F.col("n_sentences").cast("long").alias("n_sentences"),
        F.array_join("hits.id", ",").alias("sentence_ids"),
        F.coalesce(F.size("m"), F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce(F.array_join("m.license", ","), F.lit("")).alias("license_sequence"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct("m.license")), ","), F.lit("")).alias("licenses"),
        (F.coalesce(F.size("m"), F.lit(0)) > 0).alias("licensed"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle(sentences=SENTENCES, rules=RULES, max_gap: int = MAX_GAP) -> str:
    """DuckDB SQL for ``report`` over the view ``documents`` with unique doc_id."""
    known = ", ".join(f"({_quoted(i)}, {_quoted(s)})" for i, s in sentences.items())
    ruled = ", ".join(f"({k}, {_quoted(name)}, [{', '.join(map(_quoted, seq))}])" for k, (name, seq) in enumerate(rules))
    return rf"""
WITH known(id, sentence) AS (VALUES {known}),
rules(rule, license, ids) AS (VALUES {ruled}),
s AS (SELECT doc_id, list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')),
    '{_END}', chr(10), 'g'), '{_OTHER}', ' ', 'g')), '{_CUT}'), lambda x: x <> '') AS s FROM documents),
u AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM s),
hits AS (SELECT doc_id, list(id ORDER BY pos) AS ids, list(pos ORDER BY pos) AS ats
    FROM u JOIN known USING (sentence) GROUP BY doc_id),
starts AS (SELECT *, unnest(range(1, len(ids) + 1)) AS j FROM hits),
every AS (SELECT doc_id, rule, license, ats[j] AS a, ats[j + len(r.ids) - 1] AS b
    FROM starts JOIN rules r ON starts.ids[j:j + len(r.ids) - 1] = r.ids
    WHERE len(list_filter(range(1, len(r.ids)), lambda o: ats[j + o] - ats[j + o - 1] > {max_gap + 1})) = 0),
kept AS (SELECT * FROM every m WHERE NOT EXISTS (SELECT 1 FROM every o WHERE o.doc_id = m.doc_id
    AND o.rule < m.rule AND o.a <= m.b AND m.a <= o.b)),
found AS (SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY a, rule) AS seq,
    array_to_string(list_sort(list(DISTINCT license)), ',') AS names FROM kept GROUP BY doc_id)
SELECT s.doc_id, len(s.s) AS n_sentences, coalesce(array_to_string(hits.ids, ','), '') AS sentence_ids,
    coalesce(n, 0) AS n_matches, coalesce(seq, '') AS license_sequence, coalesce(names, '') AS licenses,
    coalesce(n, 0) > 0 AS licensed
FROM s LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)"""
