"""Licence scans by ordered signature rules, in DataFrame functions only.

Every word of a text is compared with the keywords of all rules at once; texts without any are done. The others are
written out word by word with each word's index behind it, so that a rule's regular expression gives the place of a match
with the match itself. Rules whose keyword is missing are skipped. Of detections that lie within another one of at least
the same priority, only the outer one counts. Everything happens within a row: nothing is shuffled.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import table
from cellwright.llm.license_rules import RULES

#: A word of a text whose A-Z are in lower case: no character of 00-2F, 3A-60 and 7B-7F.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
# Fixed values.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: How sure a detection is, by priority.
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.4}
KEYWORDS = sorted({word for rule in RULES for word in rule.keywords})


def _keywords() -> Column:
    return F.split(F.lit(" ".join(KEYWORDS)), " ")


def _rule_table() -> Column:
    """The rules as one constant, a few hundred entries long; as JSON, so that the plan holds one node for all of them."""
    rules = [{"rule": r.number, "priority": r.priority, "label": r.label, "base": r.base, "keywords": r.keywords, "pattern": r.pattern} for r in RULES]
    return F.from_json(F.lit(json.dumps(rules)), "array<struct<rule:int,priority:int,label:string,base:boolean,keywords:array<string>,pattern:string>>")


def _detections(indexed: Column, hits: Column) -> Column:
    """All matches of the rules whose keywords are among the hits: by first word, the longest first, then by rule."""

    def of_rule(rule: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(indexed, rule["pattern"], F.lit(0)),
            lambda m: F.struct(
                F.regexp_extract(m, r"^\x02[^\x01]*\x01([0-9]+)", 1).cast("long").alias("first_word"),
                (-F.regexp_extract(m, r"\x01([0-9]+)$", 1).cast("long")).alias("minus_last"),
                rule["priority"].alias("priority"),
                rule["rule"].alias("rule"),
                rule["label"].alias("label"),
                rule["base"].alias("base"),
            ),
        )

    rules = F.filter(_rule_table(), lambda r: F.arrays_overlap(hits, r["keywords"]))
    return F.array_sort(F.flatten(F.transform(rules, of_rule)))


def _judged(detections: Column) -> Column:
    """Labels, number and greatest confidence of the detections that do not lie within another of at least their priority.

    The reach by priority is the last word of any detection before, of that priority or a stronger one. A container comes
    before what it contains, so a detection is contained where that reach is not before its own last word.
    """
    start = F.struct(
        F.array(*[F.lit(-1).cast("long") for _ in CONFIDENCE]).alias("reach"),
        F.array().cast("array<string>").alias("labels"),
        F.lit(0).cast("long").alias("n"),
        F.lit(0.0).alias("score"),
    )
    confidence = F.array(*[F.lit(CONFIDENCE[p]) for p in sorted(CONFIDENCE)])

    def step(state: Column, d: Column) -> Column:
        last, at = -d["minus_last"], d["priority"] - 1
        stays = F.get(state["reach"], at) < last
        return F.struct(
            F.transform(state["reach"], lambda r, p: F.when(p >= at, F.greatest(r, last)).otherwise(r)).alias("reach"),
            F.when(stays, F.array_union(state["labels"], F.array(d["label"]))).otherwise(state["labels"]).alias("labels"),
            (state["n"] + stays.cast("long")).alias("n"),
            F.when(stays, F.greatest(state["score"], F.get(confidence, at))).otherwise(state["score"]).alias("score"),
        )

    return F.aggregate(detections, start, step)


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``detections``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    Words are runs of letters, digits and characters beyond ASCII, counted from 0, A-Z in lower case. ``detections`` holds
    every match: label, rule, priority, first and last word. Places of the base phrases are counted wherever they stand.
    ``labels`` are those of the base and of detections that are not inside another of at least the same priority; where
    two overlap and neither holds the other, both count. A rule's own matches do not overlap each other. ``score`` is the
    confidence of the surest of them, 0 without any. NULL and empty texts have no words and empty labels. Each row is judged
    by itself, so repeated rows agree. Columns that have one of the names above are replaced; others stay as they are.
    """
    made = ["n_words", "detections", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    names = [n for n in docs.columns if n not in made]
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"))
    # F.lower also changes letters beyond ASCII, which may only let a text through that a rule then does not match.
    rows = rows.select("row", F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)).alias("words"))
    some = F.arrays_overlap("words", _keywords())
    rows = rows.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.when(some, F.array_intersect("words", _keywords())).alias("hits"),
    )
    numbered = F.transform(
        F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)),
        lambda w, k: F.concat(F.lit("\x02"), w, F.lit("\x01"), k.cast("string")),
    )
    # An array of one stands for a local variable: the words are written out once, not once for each rule.
    once = F.array(F.struct(F.array_join(numbered, "").alias("indexed"), F.col("hits").alias("hits")))
    found = F.get(F.transform(once, lambda s: _detections(s["indexed"], s["hits"])), F.lit(0))
    none = F.from_json(F.lit("[]"), "array<struct<first_word:bigint,minus_last:bigint,priority:int,rule:int,label:string,base:boolean>>")
    rows = rows.select("row", "n_words", F.when(F.col("hits").isNotNull(), found).otherwise(none).alias("found"))
    rows = rows.select("row", "n_words", "found", F.filter("found", lambda d: d["base"]).alias("bases"), _judged(F.col("found")).alias("judged"))
    first_words = F.transform("bases", lambda d: d["first_word"])
    base_labels = F.array_distinct(F.transform("bases", lambda d: d["label"]))
    public = F.transform(
        "found",
        lambda d: F.struct(d["label"].alias("label"), d["rule"].alias("rule"), d["priority"].alias("priority"), d["first_word"].alias("first_word"), (-d["minus_last"]).alias("last_word")),
    )
    return rows.select(
        *[F.col("row").getField(n).alias(n) for n in names],
        "n_words",
        public.alias("detections"),
        F.size("bases").cast("long").alias("n_base"),
        F.array_min(first_words).alias("first_word"),
        F.array_max(first_words).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("judged.labels"))), ",").alias("labels"),
        F.col("judged.score").alias("score"),
    )


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _sql() -> str:
    rules = ",\n  ".join(f"({r.number}, {r.priority}, '{r.label}', {str(r.base).lower()}, '{r.pattern}')" for r in RULES)
    confidence = " ".join(f"WHEN {p} THEN {c}" for p, c in CONFIDENCE.items())
    # No rule matches a text without one of these parts; DuckDB takes this filter in place of the keywords.
    stems = "|".join(sorted({w for w in KEYWORDS if not any(o != w and o in w for o in KEYWORDS)}))
    return f"""
WITH rules(rule, priority, label, base, pattern) AS (VALUES
  {rules}),
worded AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words
  FROM documents),
indexed AS MATERIALIZED (
  SELECT r, list_aggregate(list_transform(words, lambda w, k: concat(chr(2), w, chr(1), k - 1)), 'string_agg', '') AS body
  FROM worded WHERE regexp_matches(array_to_string(words, ' '), '{stems}')),
found AS (
  SELECT r, rule, priority, label, base, unnest(regexp_extract_all(body, pattern)) AS m FROM indexed, rules),
placed AS MATERIALIZED (
  SELECT r, rule, priority, label, base, regexp_extract(m, '^\\x02[^\\x01]*\\x01([0-9]+)', 1)::BIGINT AS f,
    regexp_extract(m, '\\x01([0-9]+)$', 1)::BIGINT AS l FROM found),
kept AS (
  SELECT * FROM placed a WHERE NOT EXISTS (
    SELECT 1 FROM placed b WHERE b.r = a.r AND b.f <= a.f AND b.l >= a.l AND b.priority <= a.priority
      AND (b.f < a.f OR b.l > a.l OR b.priority < a.priority OR b.rule < a.rule))),
based AS (
  SELECT r, count(*) AS n, min(f) AS f, max(f) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM placed WHERE base GROUP BY r),
named AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM kept UNION SELECT r, label FROM placed WHERE base) GROUP BY r),
scored AS (SELECT r, max(CASE priority {confidence} END)::DOUBLE AS score FROM kept GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.f AS first_word, b.l AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(m.labels, '') AS labels, coalesce(s.score, 0)::DOUBLE AS score
FROM worded w LEFT JOIN based b USING (r) LEFT JOIN named m USING (r) LEFT JOIN scored s USING (r)
"""


QUERIES = {"op11_licenses": op11_licenses}
ORACLE = {"op11_licenses": _sql()}
