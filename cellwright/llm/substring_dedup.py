"""Substring deduplication: paragraph MinHash banding, exact verification, removal by components.

A text is cut into sentences, and a choice by word codes joins them into paragraphs, so a passage that is pasted into
another text gives the same paragraphs there but for its ends. A second cut, at local minima of the word codes, gives shorter
ones, so that also a passage without sentence ends has a whole one. Equal paragraphs are one class. Wide ones with a common
band of minimum hashes meet in a block, where a prefix tree finds all pairs whose word shingles have an exact Jaccard
index of 0.8. Components of what is alike are removed but for their first place, and a removal grows to both sides as
long as the words before and after agree with those around the place that stays.

A band that very many classes share (they have a common sentence) is compared in slices, as in ``jaccard``: what is not
linked with its first class visits the other slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import (
    cut, delete_table, in_tasks, mixed, ranged_codes, row_key, scratch_path, shingle_codes, shuffles_freed, table, utf8, word_codes, word_spans,
)
from cellwright.llm.components import components
from cellwright.llm.jaccard import sliced_links

WIDTH = 5
#: Bands of minimum hashes and hashes per band: two paragraphs that are 0.8 alike meet with a chance of 0.994.
BANDS, ROWS = 5, 2
#: A paragraph has so many words at least, and then ends after one sentence in ENDS or one word in LONG.
LEAST_WORDS, ENDS, LONG = 8, 2, 24
#: Words that must go together for a removal: shorter repeats stay.
LEAST_REMOVED = 40
#: Short paragraphs, of which only equal ones are found, begin where a word has the least code of so many on either side.
WINDOW = 5
#: Classes of one slice of a block.
BLOCK_CLASSES = 1000
#: Bytes of text that are cut into paragraphs together. It changes no result.
JOINED = 1 << 18

_SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_SENTENCE_END = np.isin(np.arange(256), [ord(c) for c in ".!?"])


class Paragraphs:
    """The paragraphs of UTF-8 texts, one after the other: word spans, word codes, and the words at which paragraphs begin and end.

    Words and paragraphs are numbered through all the texts. ``words_from`` and ``from_`` say with which those of a text
    begin, with one more number for the end. No paragraph goes beyond its text, and none depends on the other texts.
    """

    def __init__(self, *texts: bytes):
        self.data = data = texts[0] if len(texts) == 1 else b"\n".join(texts)
        self.starts, self.ends = word_spans(data)
        self.codes = word_codes(data, (self.starts, self.ends))
        n = len(self.codes)
        #: Where each text begins; one byte lies between two of them.
        self.bytes_from = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.words_from = np.searchsorted(self.starts, self.bytes_from)
        if not n:
            self.first = self.stop = self.least = np.zeros(0, np.int64)
            self.wide = np.zeros(0, bool)
            self.from_ = np.zeros(len(texts) + 1, np.int64)
            return
        letters = np.frombuffer(data, np.uint8)
        # A sentence ends with a word that ends in a full stop, or at a line end.
        ends = _SENTENCE_END[letters[self.ends - 1]]
        lines = np.concatenate([[0], np.cumsum(letters == 10)])
        ends[:-1] |= lines[self.starts[1:]] > lines[self.ends[:-1]]
        # The last two words choose whether the paragraph ends there.
        before = np.concatenate([[np.uint64(0)], self.codes[:-1]])
        before[self.words_from[:-1][self.words_from[:-1] < n]] = 0
        choice = mixed(self.codes ^ mixed(before))
        edges = np.zeros(n + 1, bool)
        edges[self.words_from] = True
        may = edges.copy()
        may[1:] |= (ends & (choice % np.uint64(ENDS) == 0)) | (choice % np.uint64(LONG) == 0)
        stops, last = [], 0
        at = np.flatnonzero(may)
        for k, edge in zip(at.tolist(), edges[at].tolist()):
            if edge or k - last >= LEAST_WORDS:
                stops.append(k)
                last = k
        wide = np.array(stops)
        # A short one begins where the choice is the least of those around, so wherever ends are rare there are such places.
        place = np.arange(n) + WINDOW * np.repeat(np.arange(1, len(texts) + 1), np.diff(self.words_from))
        padded = np.full(n + WINDOW * (len(texts) + 1), 2**64 - 1, np.uint64)
        padded[place] = choice
        inner = len(padded) - 2 * WINDOW
        left, right = padded[:inner].copy(), padded[WINDOW + 1 : WINDOW + 1 + inner].copy()
        for k in range(1, WINDOW):
            np.minimum(left, padded[k : k + inner], out=left)
            np.minimum(right, padded[WINDOW + 1 + k : WINDOW + 1 + k + inner], out=right)
        place -= WINDOW
        self.least = np.flatnonzero((left[place] > choice) & (right[place] >= choice))  # of equal ones the first
        edges[self.least] = True
        short = np.flatnonzero(edges)
        wide_spans, short_spans = (e[:-1] * (n + 1) + e[1:] for e in (wide, short))
        spans = np.union1d(wide_spans, short_spans)
        self.first, self.stop = spans // (n + 1), spans % (n + 1)
        self.wide = np.isin(spans, wide_spans, assume_unique=True)
        self.from_ = np.searchsorted(self.first, self.words_from)

    def reach(self, a: np.ndarray, b: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Up to which words before ``a`` and after ``b`` a short paragraph surely lies between, with what decides on its ends.

        A passage that goes on further on both places has that paragraph as a repeat of its own. ``text`` is the number of
        the text, beyond which nothing reaches.
        """
        k = np.searchsorted(self.least, a - WINDOW, "right") - 2
        far = np.append(self.least, len(self.codes))  # stands for no such place
        low = np.where(k >= 0, far[np.maximum(k, 0)] - WINDOW - 1, 0)
        k = np.searchsorted(self.least, b + WINDOW + 1) + 1
        high = far[np.minimum(k, len(self.least))] + WINDOW + 1
        return np.maximum(low, self.words_from[text]), np.minimum(high, self.words_from[text + 1])


def in_groups(texts: pa.Array) -> Iterator[tuple[int, Paragraphs]]:
    """The paragraphs of neighbouring texts together, about JOINED bytes at a time, and the number of the first of them."""
    at, group, size = 0, [], 0
    for k, text in enumerate(texts):
        data = utf8(text)
        if group and size + len(data) > JOINED:
            yield at, Paragraphs(*group)
            at, group, size = k, [], 0
        group.append(data)
        size += len(data)
    if group:
        yield at, Paragraphs(*group)


def paragraph_keys(found: Paragraphs, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the paragraphs, or of the ``wide`` ones, that are long enough, and a code of the words of each."""
    enough = found.stop - found.first > WINDOW
    long = np.flatnonzero(enough & found.wide & (found.stop - found.first >= LEAST_WORDS) if wide else enough)
    return long, ranged_codes(found.codes, found.first[long], found.stop[long]).view(np.int64)


def band_codes(found: Paragraphs, long: np.ndarray) -> np.ndarray:
    """The bands of each of the ``long`` paragraphs: minimum hashes of its shingles, ROWS to a band."""
    shingles = shingle_codes(found.codes, WIDTH)
    # A paragraph's shingles begin at its words but the last four; between two spans reduceat gives what is not asked for.
    spans = np.column_stack([found.first[long], found.stop[long] - WIDTH + 1]).ravel()
    padded = np.append(shingles, np.uint64(0))
    least = np.empty((len(long), BANDS * ROWS), np.uint64)
    for k, seed in enumerate(_SEEDS):
        least[:, k] = np.minimum.reduceat(mixed(padded ^ seed), spans)[::2]
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(long), 1))
    for k in range(ROWS):
        out = mixed(out ^ least[:, k::ROWS])
    return out.view(np.int64)


def _places(rows: DataFrame) -> DataFrame:
    """(id, row, pos, key): every paragraph that is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, found in in_groups(batch.column(2)):
                long, keys = paragraph_keys(found)
                text = np.searchsorted(found.from_, long, "right") - 1
                of = pa.array(at + text)
                pos = (long - found.from_[text]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(pos), pa.array(keys)], ["id", "row", "pos", "key"])

    return in_tasks(rows, run, "id long, row long, pos int, key long")


def _bands(rows: DataFrame) -> DataFrame:
    """(bucket, key): bands with at least two classes, and their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # what repeats inside a task is sent once
        for batch in batches:
            for _, found in in_groups(batch.column(0)):
                long, own = paragraph_keys(found, wide=True)
                fresh = [n for n, key in enumerate(own.tolist()) if key not in seen and not seen.add(key)]
                if fresh:
                    bands = band_codes(found, long[fresh]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(bands), pa.array(np.repeat(own[fresh], BANDS))], ["bucket", "key"])
                if len(seen) > 1_000_000:
                    seen.clear()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sent = None, False  # the row before, and whether it has been sent
        for batch in batches:
            if not batch.num_rows:
                continue
            band, key = (batch.column(k).to_numpy() for k in (0, 1))
            if last is not None:
                band, key = (np.concatenate([[v], x]) for v, x in zip(last, (band, key)))
            new = np.ones(len(band), bool)  # the same class from another task is one row
            new[1:] = (band[1:] != band[:-1]) | (key[1:] != key[:-1])
            band, key = band[new], key[new]
            near = np.zeros(len(band), bool)
            near[1:] = band[1:] == band[:-1]
            near[0] = sent
            rows = near.copy()
            rows[:-1] |= near[1:]  # the first class of a band goes with the second
            rows[0] &= not sent
            last, sent = (band[-1], key[-1]), bool(near[-1])
            if rows.any():
                yield pa.RecordBatch.from_arrays([pa.array(band[rows]), pa.array(key[rows])], ["bucket", "key"])

    met = in_tasks(rows.select("text"), run, "bucket long, key long").repartition("bucket").sortWithinPartitions("bucket", "key")
    return in_tasks(met, meet, "bucket long, key long")


def _binaries(values: np.ndarray, first: np.ndarray, lengths: np.ndarray, step: int = 1) -> pa.Array:
    """For each row ``lengths`` values from ``first`` on, forwards or backwards, as bytes."""
    stops = np.cumsum(lengths)
    within = np.arange(stops[-1] if len(stops) else 0) - np.repeat(stops - lengths, lengths)
    taken = values[np.repeat(first, lengths) + step * within]
    offsets = (np.concatenate([[0], stops]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(taken)])


def _shown(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, row, pos, key, is_head, repeated, body, before, after) of wanted places.

    ``body`` has word codes where asked for. ``before`` and ``after`` have codes of the words around: of heads, and
    where a run of paragraphs that surely go ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "row", "pos", "key", "is_head", "repeated", "body", "before", "after"]
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(3)
            begin = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            pos, key, is_head, near, repeated = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
            for start, found in in_groups(batch.column(2)):
                short = (found.codes >> np.uint64(32)).astype(np.uint32)
                here = begin[start : start + len(found.from_)]
                text = np.repeat(np.arange(len(here) - 1), np.diff(here))
                # Rows equal in id and text bring their places more than once.
                at, once = np.unique(found.from_[text] + pos[here[0] : here[-1]], return_index=True)
                text, once = text[once], once + here[0]
                head, gone = is_head[once], at[repeated[once] & ~is_head[once]]
                a, b = found.first[at], found.stop[at]
                low, high = found.reach(a, b, text)
                back = np.where(head | ~np.isin(a, found.stop[gone]), a - low, 0)
                forth = np.where(head | ~np.isin(b, found.first[gone]), high - b, 0)
                asked = head & near[once]
                body = _binaries(found.codes, a, np.where(asked, b - a, 0))
                of = pa.array(start + text)
                columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(pos[once]), pa.array(key[once]), pa.array(head), pa.array(repeated[once])]
                columns += [pc.if_else(pa.array(asked), body, pa.scalar(None, pa.binary())), _binaries(short, a - 1, back, -1), _binaries(short, b, forth)]
                yield pa.RecordBatch.from_arrays(columns, names)

    lists = wanted.groupBy("id", "row").agg(F.collect_list(F.struct("pos", "key", "is_head", "near", "repeated")).alias("places"))
    lists = lists.select(F.col("id").alias("wanted_id"), F.col("row").alias("wanted_row"), "places")
    joined = rows.join(lists, (F.col("row") == F.col("wanted_row")) & F.col("id").eqNullSafe(F.col("wanted_id")))
    schema = "id long, row long, pos int, key long, is_head boolean, repeated boolean, body binary, before binary, after binary"
    return in_tasks(joined.select("id", "row", "text", "places"), run, schema)


def _word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The short word codes of all rows of a binary column, and where those of each row begin."""
    _, offsets, data = column.buffers()
    begin = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // 4
    return np.frombuffer(data, np.uint32, int(begin[-1])) if data is not None else np.zeros(0, np.uint32), begin


def _agreement(a: pa.Array, b: pa.Array) -> np.ndarray:
    """How many words agree from the beginning of two rows of codes on, row by row."""
    (x, x_from), (y, y_from) = _word_codes(a), _word_codes(b)
    n = np.minimum(np.diff(x_from), np.diff(y_from)).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    differ = np.flatnonzero(x[x_from[row] + within] != y[y_from[row] + within])
    rows, first = np.unique(row[differ], return_index=True)
    n[rows] = within[differ[first]]
    return n


def _read_body(value: pa.Scalar) -> np.ndarray:
    return np.unique(shingle_codes(np.frombuffer(utf8(value), np.uint64), WIDTH))


def _near_classes(bands: DataFrame, bodies: DataFrame) -> DataFrame:
    """Links (a, b) that span the components of alike classes inside each bucket."""
    # Alike classes meet in several bands; of buckets with the same classes one is enough.
    sums = [F.sum(F.xxhash64(F.lit(k), "key").cast("decimal(20,0)")).alias(f"s{k}") for k in (1, 2)]
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("hub"), *sums).where("n > 1")
    once = sizes.groupBy("n", "s1", "s2").agg(F.min(F.struct("bucket", "hub")).alias("of")).select("of.*")
    members = cut(bands.join(once, "bucket").select(F.col("bucket").alias("block"), "hub", "key"), "bands")
    return sliced_links(members, lambda placed: placed.join(bodies.select("key", "body"), "key"), _read_body, BLOCK_CLASSES).distinct()


def find_repeats(rows: DataFrame) -> DataFrame:
    """(id, row, pos, back, forth, kept_id): paragraphs to remove, with the words before and after that go with them."""
    with shuffles_freed(rows.sparkSession):
        return _find_repeats(rows)


def _find_repeats(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    # Tables whose rows have all gone into later tables are deleted.
    at = {name: scratch_path(spark, name) for name in ("places", "bands", "wanted", "shown")}
    places = cut(_places(rows), path=at["places"])
    order = F.struct(F.coalesce("id", F.lit(-(2**63))).alias("at"), "row", "pos")
    classes = places.groupBy("key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    bands = cut(_bands(rows), path=at["bands"])
    near = bands.select("key").distinct().withColumn("near", F.lit(True))
    # Texts are looked at again only where a class is repeated or may be near another.
    chosen = classes.join(near, "key", "left").where("n > 1 OR near")
    chosen = chosen.select(F.col("key").alias("of"), "first", (F.col("n") > 1).alias("repeated"), F.coalesce("near", F.lit(False)).alias("near"))
    wanted = places.join(chosen, F.col("key") == F.col("of")).select("id", "row", "pos", "key", "near", (order == F.col("first")).alias("is_head"), "repeated")
    wanted = cut(wanted, path=at["wanted"])
    delete_table(spark, at["places"])
    shown = cut(_shown(rows, wanted), path=at["shown"])
    delete_table(spark, at["wanted"])
    heads = shown.where("is_head")  # rows equal in id and text show the same head
    named = components(_near_classes(bands, heads.where("body IS NOT NULL").select("key", "body").dropDuplicates(["key"])))
    delete_table(spark, at["bands"])
    # The first place of each component stays: the heads of its other classes go, and their classes with them.
    linked = heads.select("key", order.alias("order")).join(named, F.col("key") == F.col("node"))
    first = linked.groupBy("component").agg(F.min(F.struct("order", "key")).alias("first")).select("component", F.col("first.key").alias("kept_key"))
    moved = cut(named.join(first, "component").where("node <> kept_key").select(F.col("node").alias("of"), "kept_key"), "moved")
    places = shown.select("id", "row", "pos", "key", "before", "after", "is_head", "repeated")
    goes = places.where("NOT is_head").join(moved, F.col("key") == F.col("of"), "left").withColumn("kept_key", F.coalesce("kept_key", "key"))
    goes = goes.unionByName(places.where("is_head").join(moved, F.col("key") == F.col("of")))
    found = places.where("is_head")
    kept = found.where("repeated").unionByName(found.where("NOT repeated").join(moved.select(F.col("kept_key").alias("key")).distinct(), "key", "left_semi"))
    kept = kept.dropDuplicates(["key"]).select(F.col("key").alias("of_kept"), F.col("id").alias("kept_id"), F.col("before").alias("kept_before"), F.col("after").alias("kept_after"))
    removed = goes.join(kept, F.col("kept_key") == F.col("of_kept")).select("id", "row", "pos", "before", "after", "kept_before", "kept_after", "kept_id")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [_agreement(batch.column(a), batch.column(b)) for a, b in ((3, 5), (4, 6))]
            columns = [batch.column(0), batch.column(1), batch.column(2), *(pa.array(s.astype(np.int32)) for s in sides), batch.column(7)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "row", "pos", "back", "forth", "kept_id"])

    grown = cut(in_tasks(removed, grow, "id long, row long, pos int, back int, forth int, kept_id long"), "removed")
    delete_table(spark, at["shown"])
    return grown


def removed_spans(found: Paragraphs, places: list[dict], text: int = 0) -> list[tuple[int, int, list[int]]]:
    """Spans of bytes to cut out of a text, with the ids of the documents that keep the passage; short spans are left alone."""
    runs: list[list] = []
    first, origin = int(found.from_[text]), int(found.bytes_from[text])
    for p in sorted(places, key=lambda p: p["pos"]):
        a, b = int(found.first[first + p["pos"]]) - p["back"], int(found.stop[first + p["pos"]]) + p["forth"]
        kept = [p["kept_id"]] if p["kept_id"] is not None else []
        if runs and a <= runs[-1][1]:
            runs[-1][0], runs[-1][1] = min(a, runs[-1][0]), max(b, runs[-1][1])
            runs[-1][2] += kept
        else:
            runs.append([a, b, kept])
    return [(int(found.starts[a]) - origin, int(found.ends[b - 1]) - origin, sorted(set(kept))) for a, b, kept in runs if b - a >= LEAST_REMOVED]


_GAP = regex.compile(rb"[\x20\x09-\x0D]*")


def without(data: bytes, spans: list[tuple[int, int, list[int]]]) -> bytes:
    """The text without the spans; of the blanks on both sides of one, those before it stay."""
    out, at = [], 0
    for a, b, _ in spans:
        out.append(data[at:a])
        at = _GAP.match(data, b).end()
    return b"".join([*out, data[at:]])


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the passages that occur in an earlier place, with ``removed_spans`` and ``kept_in``.

    ``removed_spans`` are (start, end) in UTF-8 bytes of the text given; ``kept_in`` are ids of documents where what was
    removed stays. The first place by id, then by row key, then by position stays, also within one text. Rows equal in
    id and text are one document and change alike. NULL texts stay NULL; a text that is wholly repeated becomes empty
    and its row stays. Other columns stay, whatever their names, but for the two that are added.
    """
    names = [n for n in docs.columns if n not in ("removed_spans", "kept_in")]
    rows = docs.select(docs[id_col].cast("long").alias("id"), row_key(docs[id_col], docs[text_col]).alias("row"), docs[text_col].alias("text"))
    gone = find_repeats(rows).groupBy("id", "row").agg(F.collect_set(F.struct("pos", "back", "forth", "kept_id")).alias("places"))
    gone = gone.select(F.col("id").alias("gone_id"), F.col("row").alias("gone_row"), "places")
    whole = docs.select(F.struct("*").alias("row"), docs[id_col].cast("long").alias("id"), row_key(docs[id_col], docs[text_col]).alias("key"))
    joined = whole.join(gone, (F.col("key") == F.col("gone_row")) & F.col("id").eqNullSafe(F.col("gone_id")), "left")
    judged = joined.select("row", F.col("row").getField(text_col).alias("text"), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, kept = batch.column(1).to_pylist(), [[]] * batch.num_rows, [[]] * batch.num_rows
            hit = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False) & batch.column(2).is_valid().to_numpy(zero_copy_only=False))
            wanted, places = batch.column(1).take(pa.array(hit)), batch.column(2).take(pa.array(hit)).to_pylist()
            for at, found in in_groups(wanted):
                for k in range(len(found.from_) - 1):
                    gone = removed_spans(found, places[at + k], k)
                    if gone:
                        row, begin, stop = int(hit[at + k]), *found.bytes_from[k : k + 2].tolist()
                        texts[row] = without(found.data[begin : stop - 1], gone).decode("utf-8")
                        spans[row] = [{"start": a, "end": b} for a, b, _ in gone]
                        kept[row] = sorted({i for _, _, ids in gone for i in ids})
            kinds = [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64())]
            added = [pa.array(c, kind) for c, kind in zip((texts, spans, kept), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *added], ["row", "cleaned", "removed_spans", "kept_in"])

    kind = judged.schema["row"].dataType.simpleString()
    done = in_tasks(judged, run, f"row {kind}, cleaned string, removed_spans array<struct<start: bigint, end: bigint>>, kept_in array<bigint>")
    return done.select(*(F.col("cleaned").alias(n) if n == text_col else F.col("row").getField(n).alias(n) for n in names), "removed_spans", "kept_in")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents")).select("doc_id", "text", F.size("removed_spans").alias("removed"), "removed_spans", "kept_in")


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLE: dict[str, str] = {}
