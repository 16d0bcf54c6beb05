"""License scan by ordered signature rules, in DataFrame functions only and without a shuffle.

A text is cut into words; every rule is a regular expression over a fixed number of words, with a
label, a priority, a weight and a keyword. A rule is tried on texts that hold its keyword. The
places where it matches are word intervals. Of all intervals of a text, one that lies in another
is suppressed, of equal ones that of lower priority; base phrases stay always.

About 400 rules are written (``license_rules`` and the sentences here); the others, about 700, are license names and
versions in the frames that name them (``rules``). Of intervals that are equal in place and priority the first by
label suppresses the others. Everything about a document happens in its own row, in time linear in its
length, so no document waits for another and no key can be hot.

Defined cases: a null text is an empty one; a text without words has n_words 0, null places, empty
labels and score 0; very long texts are scanned whole. Rows are kept as often as they occur, with null ids; extra columns are
ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.llm.license_rules import WRITTEN

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE = ("array<struct<keyword: string, expression: string, mark: string, words: int, label: string, "
        "priority: int, weight: double, base: boolean>>")
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License names as written in texts, their labels, and their versions.
NAMES = {
    "mit": ("mit", ""), "expat": ("mit", ""), "x11": ("x11", ""),
    "bsd": ("bsd", ""), "bsd 2 clause": ("bsd-2-clause", ""), "bsd 3 clause": ("bsd-3-clause", ""), "bsd 4 clause": ("bsd-4-clause", ""),
    "modified bsd": ("bsd-3-clause", ""), "simplified bsd": ("bsd-2-clause", ""),
    "apache": ("apache", "1.0 1.1 2.0"), "apache software": ("apache", "1.1 2.0"),
    "gnu general public": ("gpl", "1 2 3 2.0 3.0"), "gpl": ("gpl", "1 2 3 2.0 3.0"), "gnu gpl": ("gpl", "2 3 2.0 3.0"),
    "gnu lesser general public": ("lgpl", "2.1 3 3.0"), "gnu library general public": ("lgpl", "2 2.0"),
    "lgpl": ("lgpl", "2 2.1 3 3.0"),
    "gnu affero general public": ("agpl", "1 3 3.0"), "agpl": ("agpl", "1 3 3.0"),
    "gnu free documentation": ("gfdl", "1.1 1.2 1.3"),
    "mozilla public": ("mpl", "1.0 1.1 2.0"), "eclipse public": ("epl", "1.0 2.0"),
    "eclipse distribution": ("edl", "1.0"), "common public": ("cpl", "0.5 1.0"), "ibm public": ("ipl", "1.0"),
    "common development and distribution": ("cddl", "1.0 1.1"), "european union public": ("eupl", "1.0 1.1 1.2"),
    "microsoft public": ("ms-pl", ""), "microsoft reciprocal": ("ms-rl", ""),
    "isc": ("isc", ""), "zlib": ("zlib", ""), "libpng": ("libpng", "2.0"), "boost software": ("boost", "1.0"),
    "artistic": ("artistic", "1.0 2.0"), "perl artistic": ("artistic", ""), "python software foundation": ("python", "2"),
    "ruby": ("ruby", ""), "php": ("php", "3.0 3.01"), "tcl tk": ("tcl", ""), "vim": ("vim", ""), "curl": ("curl", ""),
    "openssl": ("openssl", ""), "postgresql": ("postgresql", ""), "unicode": ("unicode", ""), "icu": ("icu", ""),
    "sil open font": ("ofl", "1.0 1.1"), "open database": ("odbl", "1.0"), "open data commons attribution": ("odc-by", "1.0"),
    "academic free": ("afl", "1.1 2.0 2.1 3.0"), "open software": ("osl", "1.0 2.0 2.1 3.0"), "q public": ("qpl", "1.0"),
    "university of illinois ncsa open source": ("ncsa", ""), "educational community": ("ecl", "1.0 2.0"),
    "business source": ("bsl", "1.0 1.1"), "server side public": ("sspl", "1"), "elastic": ("elastic", "2.0"),
    "creative commons attribution": ("cc-by", "1.0 2.0 2.5 3.0 4.0"),
    "creative commons attribution sharealike": ("cc-by-sa", "2.0 2.5 3.0 4.0"),
    "creative commons attribution noncommercial": ("cc-by-nc", "2.0 2.5 3.0 4.0"),
    "creative commons attribution noderivs": ("cc-by-nd", "2.0 2.5 3.0"),
    "creative commons attribution noderivatives": ("cc-by-nd", "4.0"),
    "cc by sa": ("cc-by-sa", "2.0 2.5 3.0 4.0"), "cc by nc": ("cc-by-nc", "2.0 2.5 3.0 4.0"),
    "cc by nd": ("cc-by-nd", "2.0 2.5 3.0 4.0"), "cc by nc sa": ("cc-by-nc-sa", "2.0 2.5 3.0 4.0"),
    "cc by nc nd": ("cc-by-nc-nd", "2.0 2.5 3.0 4.0"), "cc by": ("cc-by", "1.0 2.0 2.5 3.0 4.0"), "cc0": ("cc0", "1.0"),
}

# Sentences that stand alone (pattern, keyword, label, priority, weight).
SENTENCES = (
    ("copyright (?:19|20)[0-9][0-9]", "copyright", "copyright", 20, 0.4),
    ("copyright c (?:19|20)[0-9][0-9]", "copyright", "copyright", 20, 0.5),
    ("copyright holders?", "copyright", "copyright", 10, 0.3),
    ("all rights reserved worldwide", "reserved", "reserved", 30, 0.6),
    ("some rights reserved", "reserved", "some-rights", 20, 0.5),
    ("proprietary and confidential", "proprietary", "proprietary", 20, 0.8),
    ("(?:confidential|internal) use only", "only", "proprietary", 10, 0.5),
    ("(?:in|into|to) the public domain", "domain", "public-domain", 20, 0.8),
    ("public domain (?:dedication|work)", "domain", "public-domain", 20, 0.8),
    ("this is free and unencumbered software", "unencumbered", "unlicense", 30, 0.95),
    ("the unlicense", "unlicense", "unlicense", 20, 0.9),
    ("wtfpl", "wtfpl", "wtfpl", 20, 0.9),
    ("permission is hereby granted free of charge", "hereby", "mit", 30, 0.9),
    ("redistribution and use in source and binary forms", "redistribution", "bsd", 30, 0.9),
    ("neither the name of", "neither", "bsd", 10, 0.3),
    ("without warranty of any kind", "warranty", "warranty", 10, 0.3),
    ("the software is provided as is", "provided", "warranty", 20, 0.4),
    ("without any warranty", "warranty", "warranty", 10, 0.3),
    ("gnu is not unix", "unix", "gnu", 10, 0.2),
    ("dual licen[sc]ed", "dual", "dual", 20, 0.5),
    ("end user licen[sc]e agreement", "agreement", "eula", 20, 0.8),
    ("terms of (?:use|service)", "terms", "terms", 10, 0.3),
    ("non commercial use only", "commercial", "noncommercial", 20, 0.6),
    ("no part of this (?:publication|book|work)", "part", "reserved", 20, 0.6),
    ("may not be reproduced", "reproduced", "reserved", 20, 0.5),
)


@dataclass(frozen=True)
class Rule:
    pattern: str  # words separated by one blank, each an expression without blanks
    keyword: str  # a word of every match
    label: str
    priority: int
    weight: float
    base: bool = False

    @property
    def words(self) -> int:
        return len(self.pattern.split(" "))

    @property
    def expression(self) -> str:
        """Over a text where every word stands between blanks of its own."""
        return " " + "  ".join(self.pattern.split(" ")) + " "

    @property
    def mark(self) -> str:
        """What a match is replaced by: a mark where it starts, and as many words in all."""
        return " \x01 " + " \x02 " * (self.words - 1)


def rules() -> list[Rule]:
    """All rules, in order of priority and label."""
    found = [Rule(p, max(p.split(" "), key=len), label, 100, 0.7, True) for p, label in BASE.items()]
    found += [Rule(*s) for s in SENTENCES]
    for line in WRITTEN.splitlines():
        if line and not line.startswith("#"):
            pattern, keyword, label, priority, weight = line.split(" | ")
            found.append(Rule(pattern, keyword, label, int(priority), float(weight)))
    for name, (label, versions) in NAMES.items():
        key = max(name.split(" "), key=len)
        found.append(Rule(f"licen[sc]ed under the {name} licen[sc]e", key, label, 60, 0.97))
        found.append(Rule(f"(?:released|distributed|available|provided|published) under the {name} licen[sc]e", key, label, 60, 0.97))
        found.append(Rule(f"under the terms of the {name} licen[sc]e", key, label, 60, 0.97))
        found.append(Rule(f"{name} licen[sc]e", key, label, 30, 0.85))
        found.append(Rule(f"spdx licen[sc]e identifier {name}", key, label, 70, 1.0))
        for version in versions.split():
            number = version.replace(".", " ")
            exact = f"{label}-{version}"
            found.append(Rule(f"{name} {number}", key, exact, 40, 0.8))
            found.append(Rule(f"{name} v{number}", key, exact, 40, 0.8))
            found.append(Rule(f"{name} licen[sc]e version {number}", key, exact, 50, 0.95))
    unique = {r.pattern: r for r in sorted(found, key=lambda r: r.priority)}
    return sorted(unique.values(), key=lambda r: (-r.priority, r.label, r.pattern))


def scan_licenses(docs: DataFrame, signatures: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    signatures = rules() if signatures is None else signatures
    # One text literal, which the optimizer turns into one array: quicker to plan than thousands of literals.
    table = F.from_json(F.lit(json.dumps([{
        "keyword": r.keyword, "expression": r.expression, "mark": r.mark, "words": r.words, "label": r.label,
        "priority": r.priority, "weight": r.weight, "base": r.base} for r in signatures])), RULE)
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in signatures})])
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    body = docs.select("doc_id", F.trim(F.regexp_replace(text, NO_WORD, " ")).alias("body"))
    words = body.select("doc_id", "body", F.when(F.col("body") == "", F.array().cast("array<string>"))
                        .otherwise(F.split("body", " ")).alias("words"))
    gated = words.select("doc_id", "body", F.size("words").cast("long").alias("n_words"),
                         F.array_intersect("words", keywords).alias("held"))
    spaced = F.concat(F.lit(" "), F.replace(F.col("body"), F.lit(" "), F.lit("  ")), F.lit(" "))
    spaced = gated.select("doc_id", "n_words", "held", F.when(F.size("held") > 0, spaced).alias("spaced"))

    def places(rule):
        marked = F.split(F.trim(F.regexp_replace(F.col("spaced"), rule["expression"], rule["mark"])), " +")
        starts = F.filter(F.transform(marked, lambda w, i: F.when(w == "\x01", i)), lambda i: i.isNotNull())
        return F.transform(starts, lambda s: F.struct(
            s.alias("start"), (-(s + rule["words"])).alias("minus_end"), (-rule["priority"]).alias("rank"),
            rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base")))

    tried = F.filter(table, lambda r: F.array_contains(F.col("held"), r["keyword"]) & F.regexp_like(F.col("spaced"), r["expression"]))
    detections = spaced.select("doc_id", "n_words", F.when(
        F.col("spaced").isNotNull(), F.sort_array(F.flatten(F.transform(tried, places)))).alias("found"))
    # In this order an interval lies in an earlier one just if none of them ends after it.
    start = F.struct(F.lit(-1).alias("reach"), F.array().cast("array<string>").alias("labels"),
                     F.lit(0.0).alias("score"), F.lit(0).alias("n"))

    def step(state, x):
        stays = x["base"] | (-x["minus_end"] > state["reach"])
        return F.struct(
            F.greatest(state["reach"], -x["minus_end"]).alias("reach"),
            F.when(stays, F.array_union(state["labels"], F.array(x["label"]))).otherwise(state["labels"]).alias("labels"),
            F.when(stays, F.greatest(state["score"], x["weight"])).otherwise(state["score"]).alias("score"),
            (state["n"] + stays.cast("int")).alias("n"))

    judged = detections.select(
        "doc_id", "n_words", F.filter("found", lambda x: x["base"]).alias("base"),
        F.when(F.size("found") > 0, F.aggregate("found", start, step)).alias("kept"))
    starts = F.col("base.start")
    return judged.select(
        "doc_id", "n_words", F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.coalesce(F.array_join(F.sort_array(F.array_distinct("base.label")), ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(F.sort_array("kept.labels"), ","), F.lit("")).alias("labels"),
        F.coalesce("kept.score", F.lit(0.0)).alias("score"), F.coalesce("kept.n", F.lit(0)).cast("long").alias("n_detections"))


def quoted(text: str) -> str:
    """A string of DuckDB; the two marks are written by their codes."""
    return "'" + text.replace("'", "''").replace("\x01", "'||chr(1)||'").replace("\x02", "'||chr(2)||'") + "'"


def oracle() -> str:
    """The same rows in DuckDB, rule by rule over documents that hold the keyword."""
    values = ",\n".join(
        f"({quoted(r.keyword)}, {quoted(r.expression)}, {quoted(r.mark)}, {r.words}, {quoted(r.label)}, {r.priority}, {r.weight}::DOUBLE, {r.base})"
        for r in rules())
    return f"""
WITH rules(keyword, expression, mark, size, label, priority, weight, base) AS (VALUES {values}),
body AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                '{NO_WORD}', ' ', 'g')) AS body FROM documents),
words AS (SELECT doc_id, body, CASE WHEN body = '' THEN []::VARCHAR[] ELSE string_split(body, ' ') END AS words FROM body),
spaced AS (SELECT doc_id, words, ' ' || replace(body, ' ', '  ') || ' ' AS spaced FROM words),
tried AS (SELECT d.doc_id, r.size, r.label, r.priority, r.weight, r.base,
                 string_split(trim(replace(regexp_replace(spaced, expression, mark, 'g'), '  ', ' ')), ' ') AS marked
          FROM spaced d JOIN rules r ON contains(d.spaced, ' ' || r.keyword || ' ') AND regexp_matches(d.spaced, r.expression)),
found AS (SELECT doc_id, size, label, priority, weight, base,
                 unnest(list_filter(range(len(marked)), lambda i: marked[i + 1] = chr(1))) AS start FROM tried),
judged AS (SELECT *, max(start + size) OVER (PARTITION BY doc_id ORDER BY start, size DESC, priority DESC, label, weight, base
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM found),
counted AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
                   max(start) FILTER (base) AS last_word,
                   list_sort(list(DISTINCT label) FILTER (base)) AS base_labels,
                   list_sort(list(DISTINCT label) FILTER (base OR reach IS NULL OR start + size > reach)) AS labels,
                   max(weight) FILTER (base OR reach IS NULL OR start + size > reach) AS score,
                   count(*) FILTER (base OR reach IS NULL OR start + size > reach) AS n FROM judged GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(c.n_base, 0)::BIGINT AS n_base,
       c.first_word::BIGINT AS first_word, c.last_word::BIGINT AS last_word,
       coalesce(array_to_string(c.base_labels, ','), '') AS base_labels,
       coalesce(array_to_string(c.labels, ','), '') AS labels,
       coalesce(c.score, 0)::DOUBLE AS score, coalesce(c.n, 0)::BIGINT AS n_detections
FROM spaced d LEFT JOIN counted c USING (doc_id)"""
