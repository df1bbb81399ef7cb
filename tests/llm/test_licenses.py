"""Licence scans: places, suppression, odd rows, and the prefilter."""

import re

from cellwright.llm.license_rules import RULES, spellings, word_pattern
from cellwright.llm.licenses import scan_licenses


def scan(spark, texts):
    rows = scan_licenses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    return [row.asDict(recursive=True) for row in sorted(rows, key=lambda r: r["doc_id"])]


def test_base_places_and_labels(spark):
    texts = [
        "Licensed under CC BY-NC 4.0.",
        "cc by cc by; CC/BY",
        "see the MIT\nLicense, not the mitlicense",
        "This is under the GNU  General Public\tLicense, version 3.",
        "Apache-License",
        "Àapache license",
    ]
    found = scan(spark, texts)
    assert [(r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found] == [
        (1, 2, 2, "cc-by"),
        (3, 0, 4, "cc-by"),
        (1, 2, 2, "mit"),
        (1, 4, 4, "gpl"),
        (1, 0, 0, "apache"),
        (0, None, None, ""),
    ]
    assert [r["n_words"] for r in found] == [7, 6, 7, 10, 2, 2]
    assert found[0]["labels"] == "cc-by,cc-by-nc-4.0" and found[0]["score"] == 0.9
    assert found[3]["labels"] == "gpl,gpl-3.0"


def test_contained_detections_go_but_for_stronger_ones(spark):
    tag, plain, both = scan(spark, ["SPDX-License-Identifier: Apache-2.0", "apache 2.0", "apache 2.0 or MIT License"])
    assert tag["labels"] == "apache-2.0" and tag["score"] == 1.0
    assert {d["priority"] for d in tag["detections"]} == {1, 2}
    assert plain["score"] == 0.9
    assert both["labels"] == "apache-2.0,mit"
    # A weaker phrase around a stronger identifier leaves it in place.
    (around,) = scan(spark, ["creative commons cc0 1 0"])
    assert "cc0-1.0" in around["labels"]


def test_odd_rows(spark):
    long = "word " * 20_000 + "MIT License " * 3000
    rows = [(1, None, "a"), (1, "", "b"), (None, "MIT License", "c"), (None, "MIT License", "c"), (2, long, None), (3, "\x01\x02mit\x00license\x02", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string").withColumnRenamed("labels", "score")
    found = scan_licenses(docs).collect()
    assert len(found) == 6
    by_text = {r["text"]: r for r in found}
    assert by_text[None]["n_words"] == 0 and by_text[None]["labels"] == "" and by_text[None]["score"] == 0.0
    assert by_text[""]["base_labels"] == "" and by_text[""]["first_word"] is None
    assert by_text[long]["n_base"] == 3000 and by_text[long]["last_word"] == 20_000 + 2 * 2999
    assert by_text[rows[5][1]]["n_base"] == 1
    assert scan_licenses(docs.limit(0)).count() == 0


def test_case_is_folded_for_ascii_only(spark):
    kelvin, plain = scan(spark, ["SKIP copyleft", "COPYLEFT"])
    assert kelvin["labels"] == plain["labels"] == "copyleft"
    assert kelvin["n_words"] == 2


def test_rules_are_whole_word_patterns_with_keywords():
    for rule in RULES:
        assert rule.keywords and all(re.fullmatch("[0-9a-z]+", k) for k in rule.keywords)
        re.compile(rule.pattern)


def test_spellings():
    assert sorted(spellings("licen[cs]ed?")) == ["licence", "licenced", "license", "licensed"]
    assert spellings("(a|bc)") == ["a", "bc"]
    assert re.fullmatch(word_pattern("mit *2 licen[cs]e~"), "\x02mit\x010\x02x\x011")
