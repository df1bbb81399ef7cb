"""Line deduplication by content-defined chunks, in DataFrame functions only.

A rolling hash over the hashes of two neighbouring lines says where a chunk ends, so an inserted or deleted line moves
only the boundaries around it. Chunks of several lines that occur again anywhere are removed, but for the first one.
Hashes find the candidates; a chunk goes only if its bytes are those of the first.

Only hashes and positions of chunks are grouped. The texts are shuffled by row and once, never by what repeats in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import cut, row_key, table

#: A chunk ends after one line in so many; chunks that may be removed have so many lines and characters at least.
ENDS, LEAST_LINES, LEAST_CHARS = 2, 2, 80
# Multiplier and modulus of the rolling hash.
MULTIPLIER, MODULUS = 1_000_003, 2_147_483_647


def line_code(line: Column) -> Column:
    """The first 32 bits of a line's MD5, as a number."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks(text: Column) -> Column:
    """array<struct<lines, chunk>>: the chunks of a text in order. Joined by line ends they are the text."""
    lines = F.split(text, "\n", -1)
    codes = F.transform(lines, line_code)

    def ends(state: Column) -> Column:
        rolled = F.transform(
            state["codes"],
            lambda code, k: (F.coalesce(F.get(state["codes"], k - 1), F.lit(0)) * MULTIPLIER + code) % MODULUS,
        )
        last = F.size(state["codes"]) - 1
        return F.filter(F.transform(rolled, lambda r, k: F.when((r % ENDS == 0) | (k == last), k)), lambda k: k.isNotNull())

    def cut_lines(state: Column) -> Column:
        def one(end: Column, k: Column) -> Column:
            start = F.coalesce(F.get(state["ends"], k - 1) + 1, F.lit(0))
            n = end - start + 1
            return F.struct(n.alias("lines"), F.array_join(F.slice(state["lines"], start + 1, n), "\n").alias("chunk"))

        return F.transform(state["ends"], one)

    # A one-element array stands for a local variable, so that codes and ends are worked out once.
    first = F.array(F.struct(lines.alias("lines"), codes.alias("codes")))
    second = F.transform(first, lambda s: F.struct(s["lines"].alias("lines"), ends(s).alias("ends")))
    return F.flatten(F.transform(second, cut_lines))


def _long_enough(lines: Column, chunk: Column) -> Column:
    return (lines >= LEAST_LINES) & (F.char_length(chunk) >= LEAST_CHARS)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated multi-line chunks taken out of the text, and ``removed_chunks``, how many there were.

    The first place by id, then by text, then by position keeps its chunk. Rows equal in id and text are one document
    and change alike. NULL texts stay NULL. A text that is wholly repeated becomes empty; its row stays. Other columns
    stay as they are, whatever their names, but for ``removed_chunks``.
    """
    names = docs.columns
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"), row_key(docs[id_col], docs[text_col]).alias("key"))
    light = rows.where(F.col("text").isNotNull()).select("id", "key", F.posexplode(chunks(F.col("text"))).alias("pos", "c"))
    light = light.where(_long_enough(F.col("c.lines"), F.col("c.chunk"))).select(
        "id", "key", "pos", F.xxhash64("c.chunk").alias("h1"), F.xxhash64(F.lit(1), "c.chunk").alias("h2")
    )
    light = cut(light.distinct(), "chunks")
    place = F.struct(F.coalesce("id", F.lit(-(2**63))).alias("id"), "key", "pos")
    firsts = light.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = light.withColumn("place", place).join(firsts, ["h1", "h2"])
    # What each document has to show: its repeated chunks, and whether each is the first of its kind.
    shown = again.groupBy("id", "key").agg(F.collect_list(F.struct("pos", "h1", "h2", (F.col("place") == F.col("first")).alias("is_first"))).alias("shown"))
    # The texts are shuffled once, to learn what each has to show. From here on only documents with a repeated chunk move.
    shown = shown.select(F.col("id").alias("i"), F.col("key").alias("k"), "shown")
    met = rows.drop("text").join(shown, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left")
    met = cut(met.select("row", "id", "key", "shown"), "met")
    text = F.col("row").getField(text_col)
    bodies = met.where(F.col("shown").isNotNull()).select("id", "key", "shown", chunks(text).alias("all")).select("id", "key", "all", F.inline("shown"))
    bodies = bodies.select("id", "key", "pos", "h1", "h2", "is_first", F.get("all", F.col("pos"))["chunk"].alias("chunk"))
    bodies = cut(bodies, "bodies")
    kept = bodies.where("is_first").select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.col("chunk").alias("kept")).dropDuplicates(["f1", "f2"])
    others = bodies.where("NOT is_first")
    confirmed = others.join(kept, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))).where(F.col("chunk") == F.col("kept"))
    gone = cut(confirmed.groupBy("id", "key").agg(F.collect_set("pos").alias("gone")), "gone")
    gone = gone.select(F.col("id").alias("i"), F.col("key").alias("k"), "gone")
    changed = met.where(F.col("shown").isNotNull()).join(gone, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left")
    left = F.filter(F.transform(chunks(text), lambda c, k: F.when(~F.array_contains("gone", k), c["chunk"])), lambda c: c.isNotNull())
    shorter = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n"))
    whole = [n for n in names if n != "removed_chunks"]

    def out(rows: DataFrame, body: Column, removed: Column) -> DataFrame:
        columns = [body.alias(n) if n == text_col else F.col("row").getField(n).alias(n) for n in whole]
        return rows.select(*columns, removed.cast("int").alias("removed_chunks"))

    same = out(met.where(F.col("shown").isNull()), text, F.lit(0))
    return same.union(out(changed, shorter, F.coalesce(F.size("gone"), F.lit(0))))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_chunks")


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
coded AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS code FROM lines),
rolled AS (
  SELECT *, ((coalesce(lag(code) OVER w, 0) * {MULTIPLIER} + code) % {MODULUS}) % {ENDS} = 0 AS ends FROM coded
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM rolled),
chunks AS (
  SELECT doc_id, pos, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM numbered GROUP BY doc_id, pos),
judged AS (
  SELECT *, n >= {LEAST_LINES} AND length(chunk) >= {LEAST_CHARS}
    AND row_number() OVER (PARTITION BY chunk, n >= {LEAST_LINES} ORDER BY doc_id, pos) > 1 AS gone
  FROM chunks)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text, coalesce(j.removed, 0)::INT AS removed_chunks
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(chunk, chr(10) ORDER BY pos) FILTER (NOT gone) AS text, count(*) FILTER (gone) AS removed
  FROM judged GROUP BY doc_id) j USING (doc_id)
"""
QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLE = {"op1_line_dedup": SQL}
