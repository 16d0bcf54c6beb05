"""Every written license rule finds an example of its own, and not without its keyword."""

import re

from meterlens.llm import licenses
from meterlens.llm.license_rules import WRITTEN
from tests.llm.helpers import documents

LINES = [line.split(" | ") for line in WRITTEN.splitlines() if line and not line.startswith("#")]

# Texts as they are written, and labels that have to be, and must not be, among what is found.
TEXTS = [
    ("Released as GPLv3.", "gpl-3.0", "gpl-2.0"), ("LGPLv2.1+", "lgpl-2.1", "lgpl-2.0"), ("MPL-2.0", "mpl-2.0", "mpl-1.1"), ("EPL-2.0", "epl-2.0", "epl-1.0"),
    ("BSD-3-Clause", "bsd-3-clause", "bsd"), ("CC0", "cc0", "cc-by"), ("GNU LGPL", "lgpl", "gpl"), ("license: MIT", "mit", "isc"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose", "isc", "mit"),
    ("either version 2 or any later version", "gpl-2.0-or-later", "gpl-3.0-or-later"), ("GPL-2.0-or-later", "gpl-2.0-or-later", "gpl-2.0-only"),
    ("GPL-2.0-only", "gpl-2.0-only", "gpl-2.0-or-later"), ("AGPL-3.0-or-later", "agpl-3.0-or-later", "gpl-3.0-or-later"),
    ("GNU General Public License version 2 or later", "gpl-2.0-or-later", "gpl-2.0"),
    ("under the three clause BSD license", "bsd-3-clause", "bsd-2-clause"), ("Redistributions in binary form must reproduce the above copyright notice", "bsd", "mit"),
    ("THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND", "warranty", "mit"), ("You may not use this file except in compliance with the License", "apache-2.0", "mit"),
    ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa-4.0", "cc-by-4.0"), ("the same terms as Perl itself", "perl", "ruby"),
    ("a summit on general policy", None, "mit"), ("he has a licence to fish", None, "isc"), ("apache helicopters", None, "apache"),
]


def example(pattern):
    """The first way to write a pattern."""
    words = re.sub(r"\(\?:([^|)]*)[^)]*\)", r"\1", pattern)
    return re.sub(r"\[(.)[^\]]*\]", r"\1", words).replace("?", "")


def labels(spark, texts):
    rows = licenses.scan_licenses(documents(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    return [set(r["labels"].split(",")) if r["labels"] else set() for r in rows]


def test_rules_are_well_formed():
    patterns = [p for p, *_ in LINES]
    assert len(LINES) > 350 and len(set(patterns)) == len(patterns)
    for pattern, keyword, label, priority, weight in LINES:
        assert keyword in pattern.split(" ") and re.fullmatch(r"[a-z0-9.-]+", label) and 0 < float(weight) <= 1 and 0 < int(priority) < 100
        assert all(re.fullmatch(x, w) for x, w in zip(pattern.split(" "), example(pattern).split(" ")))


def test_each_rule_finds_its_example_and_needs_its_keyword(spark):
    own = [r for r in licenses.rules() if any(r.pattern == p for p, *_ in LINES)]
    assert len(own) >= len(LINES) - 5
    scanned = licenses.scan_licenses(documents(spark, [
        (2 * i + k, f"Here {text}, we read.") for i, r in enumerate(own)
        for k, text in enumerate((example(r.pattern), example(r.pattern).replace(r.keyword, "zzz")))])).collect()
    found = {r["doc_id"]: r for r in scanned}
    longest = {}
    for i, r in enumerate(own):
        got = found[2 * i]
        # A longer rule, or one of the same words and more priority, may speak for it.
        assert got["n_detections"] > 0 and got["score"] > 0, r.pattern
        longest[r.pattern] = r.label in got["labels"].split(",")
        assert got["n_detections"] >= found[2 * i + 1]["n_detections"] or r.label not in found[2 * i + 1]["labels"].split(","), r.pattern
    assert sum(longest.values()) > 0.97 * len(longest), [p for p, ok in longest.items() if not ok]


def test_texts_as_written(spark):
    for (text, label, other), found in zip(TEXTS, labels(spark, [t for t, *_ in TEXTS])):
        assert (label in found if label else not found) and other not in found, (text, found)
