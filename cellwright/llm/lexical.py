"""Ranked lexical search of many items at once, along a graph of the term sets that they share.

The items are taken in blocks of bounded size. Terms that stand in the same items of a block are one shared set; sets that
several items or several shared sets have in common are mined next, the largest first, until no three members meet again.
That gives a graph: a node adds up its members, an item adds up what is left of it. For a batch of documents each node is
worked out once, however many items use it, and every task keeps the best documents of each item.

Texts are read once per block, to count the block's terms in them; the counts are written, and the statistics and the
scores both come from there. Nothing but each task's best rows is shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.llm.common import cut, in_tasks, table, utf8
from cellwright.operators.order import number_rows
from cellwright.session import scratch_path

#: Items that share one graph; a block's terms are all that is sent to the tasks.
BLOCK_ITEMS = 256
#: Cells (nodes times documents) of the sums that a task holds at a time.
CELLS = 4_000_000
#: Members that two sets must share to become a node; with two the node costs as much as it saves.
LEAST_SHARED = 3

_separators = bytes(b for b in range(128) if not chr(b).isalnum())
#: A-Z become a-z; every other ASCII character that is no letter and no digit becomes a blank.
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _separators, bytes(range(97, 123)) + b" " * len(_separators))


def terms(data: bytes) -> list[bytes]:
    """The terms of UTF-8 text: runs of digits, letters and anything beyond ASCII, with A-Z in lower case."""
    return data.translate(_FOLD).split()


@dataclass
class Plan:
    """The graph of a block of items. Nodes below ``n_leaves`` are sets of terms, the others sums of their members."""

    vocabulary: dict[bytes, int]
    leaf_of: np.ndarray
    n_leaves: int
    members: list[tuple[int, np.ndarray]]
    items: list[np.ndarray]

    @property
    def n_nodes(self) -> int:
        return self.n_leaves + len(self.members)


def shared_plan(sets: list[set[bytes]]) -> Plan:
    """Mine the shared term sets of the items and order them so that members come before what they are part of."""
    holders: dict[bytes, int] = {}
    for k, found in enumerate(sets):
        for term in found:
            holders[term] = holders.get(term, 0) | 1 << k
    vocabulary = {term: k for k, term in enumerate(sorted(holders))}
    leaves: dict[int, int] = {}
    leaf_of = np.array([leaves.setdefault(holders[t], len(leaves)) for t in vocabulary], np.int64)
    n_leaves = len(leaves)
    # A set is a number whose bits are its members: leaves first, then nodes in the order they are found.
    rows = [sum(1 << leaf for held, leaf in leaves.items() if held >> k & 1) for k in range(len(sets))]
    heap = [(-n, a, b) for b in range(len(rows)) for a in range(b) if (n := (rows[a] & rows[b]).bit_count()) >= LEAST_SHARED]
    heapq.heapify(heap)
    while heap:
        n, a, b = heapq.heappop(heap)
        both = rows[a] & rows[b]
        if both.bit_count() != -n:
            # Overlaps only shrink, so that an entry is a bound of what is left of it.
            if both.bit_count() >= LEAST_SHARED:
                heapq.heappush(heap, (-both.bit_count(), a, b))
            continue
        bit = 1 << (n_leaves + len(rows) - len(sets))
        for k, row in enumerate(rows):
            if row & both == both:
                rows[k] = row & ~both | bit
        rows.append(both)
        new = len(rows) - 1
        for k in range(new):
            if (n := (rows[k] & both).bit_count()) >= LEAST_SHARED:
                heapq.heappush(heap, (-n, k, new))

    def bits(row: int) -> np.ndarray:
        digits = np.frombuffer(row.to_bytes((row.bit_length() + 7) // 8 or 1, "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(digits, bitorder="little"))

    members = {n_leaves + k: bits(row) for k, row in enumerate(rows[len(sets) :])}
    order: list[int] = []
    waiting = {node: sum(m >= n_leaves for m in found) for node, found in members.items()}
    users: dict[int, list[int]] = {}
    for node, found in members.items():
        for m in found[found >= n_leaves]:
            users.setdefault(int(m), []).append(node)
    ready = [node for node, n in waiting.items() if n == 0]
    while ready:
        node = ready.pop()
        order.append(node)
        for user in users.get(node, ()):
            waiting[user] -= 1
            if waiting[user] == 0:
                ready.append(user)
    return Plan(vocabulary, leaf_of, n_leaves, [(node, members[node]) for node in order], [bits(row) for row in rows[: len(sets)]])


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, ``n`` (all its terms), and the vocabulary's terms in it with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            lengths, offsets, ids, counts = [], [0], [], []
            for text in batch.column(1):
                found = terms(utf8(text))
                lengths.append(len(found))
                here = Counter(found)
                for term in known & here.keys():
                    ids.append(vocabulary[term])
                    counts.append(here[term])
                offsets.append(len(ids))
            at = pa.array(offsets, pa.int32())
            columns = [
                batch.column(0).cast(pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())),
                pa.ListArray.from_arrays(at, pa.array(counts, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "ids", "counts"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return in_tasks(rows, run, "doc_id long, n long, ids array<int>, counts array<long>")


class _Best:
    """The best documents of every item so far: score downwards, then NULL ids, then ids upwards."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64) for _ in range(n_items)]
        self.valid = [np.zeros(0, bool) for _ in range(n_items)]
        self.ids = [np.zeros(0, np.int64) for _ in range(n_items)]

    def add(self, item: int, scores: np.ndarray, valid: np.ndarray, ids: np.ndarray) -> None:
        least = 1 if len(self.scores[item]) < self.k else max(int(self.scores[item][-1]), 1)
        if len(scores) > self.k:
            least = max(least, int(np.partition(scores, -self.k)[-self.k]))
        at = np.flatnonzero(scores >= least)
        if not len(at):
            return
        s = np.concatenate([self.scores[item], scores[at]])
        v = np.concatenate([self.valid[item], valid[at]])
        d = np.concatenate([self.ids[item], ids[at]])
        best = np.lexsort((d, v, -s))[: self.k]
        self.scores[item], self.valid[item], self.ids[item] = s[best], v[best], d[best]

    def batch(self) -> pa.RecordBatch:
        sizes = [len(s) for s in self.scores]
        ids = pa.array(np.concatenate([*self.ids, np.zeros(0, np.int64)]), mask=~np.concatenate([*self.valid, np.zeros(0, bool)]))
        items = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        scores = np.concatenate([*self.scores, np.zeros(0, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(items), ids, pa.array(scores)], ["item", "doc_id", "score"])


def best_documents(counts: DataFrame, plan: Plan, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Each task's best documents for every item of the block: item (its place in the block), doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(plan.items), k)
        rows_at_once = max(16, CELLS // max(plan.n_nodes, 1))
        for whole in batches:
            for start in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(start, rows_at_once)
                rows = batch.num_rows
                found = batch.column(2)
                ids = found.flatten().to_numpy(zero_copy_only=False)
                tf = batch.column(3).flatten().to_numpy(zero_copy_only=False)
                held = found.value_lengths().to_numpy(zero_copy_only=False)
                place = np.repeat(np.arange(rows), held)
                # Python's integers, as the product of three counts may exceed 64 bits.
                m = np.array([10 + 90 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], np.int64)
                parts = weights[ids] * (1_000_000_000 * tf // (1000 * tf + 8 * m[place]))
                sums = np.zeros((plan.n_nodes, rows), np.int64)
                np.add.at(sums.reshape(-1), plan.leaf_of[ids] * rows + place, parts)
                for node, members in plan.members:
                    sums[members].sum(axis=0, out=sums[node])
                valid = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                doc_ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                for item, members in enumerate(plan.items):
                    if len(members):
                        best.add(item, sums[members].sum(axis=0), valid, doc_ids)
        yield best.batch()

    return in_tasks(counts, run, "item long, doc_id long, score long")


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for every item, ties by ascending id.

    A NULL or empty text has no terms: such an item has no rows, such a document is not counted and never found. Items that
    agree in id and text are one item; one id with several texts gets a ranking for each. Documents are rows: repeated
    rows all count and may all be found; a NULL doc_id comes before other ids. Empty tables give an empty result. Other columns are
    not looked at. Ids are integers.
    """
    spark = docs.sparkSession
    items = items.select(items[item_col].cast("long").alias("item_id"), items[item_text_col].alias("text")).where("text IS NOT NULL").distinct()
    items = cut(number_rows(items, ["item_id", "text"], "number"), "items")
    size = items.count()
    out = scratch_path(spark, "ranked")
    totals = None
    for first in range(0, size, block_items):
        # At most block_items rows reach the driver, and all that is made of them goes to the tasks.
        block = items.where(F.col("number").between(first + 1, first + block_items)).orderBy("number").collect()
        plan = shared_plan([set(terms(row["text"].encode())) for row in block])
        counts = cut(term_counts(docs, plan.vocabulary, id_col, text_col), "term_counts")
        if totals is None:
            totals = counts.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        n_docs, n_terms = totals
        if n_docs == 0:
            break
        weights = np.zeros(len(plan.vocabulary), np.int64)
        for term, df in counts.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        best_documents(counts, plan, weights, n_docs, n_terms, k).withColumn("item", F.col("item") + first + 1).write.mode("append").parquet(out)
    if totals is None or totals[0] == 0:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = spark.read.schema("item long, doc_id long, score long").parquet(out)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = items.select(F.col("number").alias("item"), "item_id")
    return found.join(named, "item").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLDED.format("text")}, '{_TERM}') AS t FROM documents),
sized AS (SELECT r, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
asked AS MATERIALIZED (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all({_FOLDED.format("text")}, '{_TERM}')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))),
tf AS MATERIALIZED (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weighed AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, total GROUP BY term, n_docs),
parts AS MATERIALIZED (
  SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS part
  FROM tf JOIN weighed USING (term) JOIN sized USING (r), total),
scored AS (
  SELECT i, item_id, r, doc_id, sum(part)::BIGINT AS score FROM asked JOIN parts USING (term) JOIN sized USING (r) GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM placed WHERE rank <= 10
"""
QUERIES = {"op12_ranked_search": op12_ranked_search}
ORACLE = {"op12_ranked_search": SQL}
