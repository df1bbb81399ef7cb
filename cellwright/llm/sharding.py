"""Sharding by best-fit-decreasing bin packing of indivisible groups of equal texts.

Sizes are summed by group before anything is packed. Groups of at least a small fixed share of all bytes are packed one
by one; the rest are bundled by their digest into a fixed number of bundles of graded weight, the light ones of which
fill what the heavy groups leave. So at most ``2 * LIGHT + LIGHT`` sizes reach the driver, whatever the input, and
placing the rows is a lookup without a shuffle.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.llm.common import cut, table

SHARDS = 16
#: Bundles of light groups (a square root of two to the 24th).
LIGHT = 4096
#: A group is heavy from this share of all bytes on; there can be no more heavy groups than that.
HEAVY_SHARE = 2 * LIGHT
#: Rows that are numbered together inside a shard.
SLOT_ROWS = 20_000


class RoomTree:
    """Bins by (room left, bin), in a treap: the tightest bin that still takes a size is found in logarithmic time."""

    def __init__(self) -> None:
        self._root: list | None = None
        self._draw = random.Random(7).random

    def _split(self, node: list | None, key: tuple) -> tuple:
        if node is None:
            return None, None
        if node[0] < key:
            node[3], rest = self._split(node[3], key)
            return node, rest
        rest, node[2] = self._split(node[2], key)
        return rest, node

    def _join(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b

    def add(self, room: int, bin_: int) -> None:
        left, right = self._split(self._root, (room, bin_))
        self._root = self._join(self._join(left, [(room, bin_), self._draw(), None, None]), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room that is at least ``size``."""
        left, right = self._split(self._root, (size, -1))
        if right is None:
            self._root = left
            return None
        node, above = right, None
        while node[2] is not None:
            above, node = node, node[2]
        if above is None:
            right = node[3]
        else:
            above[2] = node[3]
        self._root = self._join(left, right)
        return node[0]


def best_fit_decreasing(sizes: Sequence[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each size; a size over the capacity gets a bin of its own. None once more than ``most`` bins open."""
    where = [0] * len(sizes)
    tree, opened = RoomTree(), 0
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = tree.take_tightest(sizes[k])
        if found is None:
            if most is not None and opened == most:
                return None
            found = (max(capacity, sizes[k]), opened)
            opened += 1
        where[k] = found[1]
        tree.add(found[0] - sizes[k], found[1])
    return where


def even_bins(sizes: Sequence[int], bins: int) -> list[int]:
    """Bins of near-equal sums: the least capacity with which best-fit-decreasing opens no more than ``bins``.

    A group that is larger than the mean of what is left takes a bin alone.
    """
    where = [0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    rest, first = sum(sizes), 0
    while order and bins - first > 1 and sizes[order[0]] * (bins - first) >= rest:
        k = order.pop(0)
        where[k] = first
        first += 1
        rest -= sizes[k]
    if not order:
        return where
    left = [sizes[k] for k in order]
    low = max(-(-rest // (bins - first)), left[0])
    high = low + left[0]
    best = best_fit_decreasing(left, high, bins - first)
    while low < high:
        middle = (low + high) // 2
        found = best_fit_decreasing(left, middle, bins - first)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    for k, bin_ in zip(order, best):
        where[k] = first + bin_
    return where


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes plus one; NULL counts as no text."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def _bundle(digest: Column) -> Column:
    return F.floor(F.sqrt(F.pmod(F.xxhash64(digest), F.lit(LIGHT * LIGHT)).cast("double"))).cast("int")


def shard_map(groups: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(digest, shard) of heavy groups and (bundle, shard) of bundles, from (digest, size) of all groups."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("size")).first()[0] or 0
    heavy = groups.where(F.col("size") * HEAVY_SHARE >= F.lit(total)).orderBy(F.col("size").desc(), "digest").collect()
    light = groups.where(F.col("size") * HEAVY_SHARE < F.lit(total)).groupBy(_bundle(F.col("digest")).alias("bundle")).agg(F.sum("size").alias("size")).orderBy("bundle").collect()
    where = even_bins([r["size"] for r in heavy] + [r["size"] for r in light], shards)
    return (
        spark.createDataFrame([(bytes(r["digest"]), s) for r, s in zip(heavy, where)], "digest binary, heavy_shard int"),
        spark.createDataFrame([(r["bundle"], s) for r, s in zip(light, where[len(heavy) :])], "bundle int, light_shard int"),
    )


def with_shards(rows: DataFrame, maps: tuple[DataFrame, DataFrame], digest: str = "digest") -> DataFrame:
    """``rows`` with ``shard``. Both maps are of bounded size (``HEAVY_SHARE`` and ``LIGHT`` rows) and broadcast."""
    heavy, light = maps
    kept = rows.select(F.struct("*").alias("row"), rows[digest].alias("digest")).withColumn("bundle", _bundle(F.col("digest")))
    placed = kept.join(F.broadcast(heavy), "digest", "left").join(F.broadcast(light), "bundle", "left")
    return placed.select("row.*", F.coalesce("heavy_shard", "light_shard").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, digest, shard, slot) of every row; bytes per shard are near equal, equal texts stay together.

    Slots count from 0 without gaps inside a shard, in blocks of rows. Repeated rows and rows without id are rows like
    others; NULL and empty texts form one group of size 1 each. An empty table gives no rows. To move the texts
    themselves, use ``with_shards`` on the documents; it needs no shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            text_bytes(text).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            text_digest(text).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sharding",
    )
    maps = shard_map(rows.groupBy("digest").agg(F.sum("size").alias("size")), shards)
    blocks = -(-rows.count() // SLOT_ROWS) or 1
    placed = with_shards(rows, maps).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row"))
    numbered = placed.withColumn("within", within).join(starts, ["shard", "block"])
    return numbered.select("doc_id", "size", "text_crc32", "digest", "shard", (F.col("start") + F.col("within") - 1).cast("long").alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op3_sharding": op3_sharding}
ORACLE: dict[str, str] = {}
