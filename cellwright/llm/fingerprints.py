"""Threshold-scaled document sketches: every shingle hash below a fixed fraction of the hash range is kept.

A sketch of a document is a fixed share of its shingles, however long it is. So sketches of documents can be merged into
the sketch of their union, and the containment of a short text in a long one can be estimated as well as the likeness
of two texts of one length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import in_tasks, mixed, shingle_codes, table, word_codes

#: Hashes below this share of the range are kept.
FRACTION = 0.25
WIDTH = 5
#: Documents that are put in order together, about, and the most boundaries between such ranges.
RANGE_ROWS, MOST_RANGES = 1000, 20_000


def kept_hashes(text: str, fraction: float = FRACTION) -> tuple[int, np.ndarray]:
    """The number of distinct shingles of a text, and the hashes it keeps, rising, as 32-bit numbers."""
    found = np.unique(mixed(shingle_codes(word_codes(text.encode("utf-8", "surrogatepass")), WIDTH)))
    kept = found[: np.searchsorted(found, np.uint64(int(fraction * 2.0**64)))]
    return len(found), np.unique((kept >> np.uint64(32)).astype(np.uint32))


def written(text: str, count: int, kept: np.ndarray) -> str:
    """A sketch as text: shingles, a digest of the text, and the kept hashes in base 64."""
    digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
    return f"{count}:{digest}:{base64.b64encode(kept.astype('<u4').tobytes()).decode()}"


def fingerprint(text: str | None, fraction: float = FRACTION) -> str:
    """The sketch of one text. NULL counts as empty; equal texts have equal sketches."""
    text = text or ""
    return written(text, *kept_hashes(text, fraction))


def hashes(sketch: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(sketch.rpartition(":")[2]), "<u4")


def _likeness(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return common / union if union else 0.0


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard index. Equal sketches give 1; two different sketches that kept nothing give 0."""
    return 1.0 if a == b else _likeness(hashes(a), hashes(b))


def containment(part: str, whole: str) -> float:
    """Estimated share of the first text's shingles that are in the second; a sketch that kept nothing gives 0."""
    small = hashes(part)
    return len(np.intersect1d(small, hashes(whole), assume_unique=True)) / len(small) if len(small) else 0.0


def merge(sketches: Iterable[str]) -> str:
    """The sketch of all the texts together. The count of shingles is estimated from what is kept."""
    parts = [hashes(s) for s in sketches]
    kept = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)
    return written("", round(len(kept) / FRACTION), kept)


def sketch_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_tasks(texts, run, "doc_id long, fingerprint string")


FIRST = -(2**63)  # where rows without id stand in the order


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows put in ranges of ids and ordered inside them, each range ended by the first rows of the next one (``tail``).

    The ranges begin at ids that occur, so the row that ends a range is known without another pass. The texts are
    shuffled once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(FIRST)))
    count, least = rows.agg(F.count(F.lit(1)), F.min("at")).first()
    if not count:
        return rows.select(F.lit(0).alias("part"), F.lit(0).alias("tail"), "at", "doc_id", "text")
    ranges = min(-(-count // RANGE_ROWS), MOST_RANGES)
    shares = [k / ranges for k in range(1, ranges)]
    inner = rows.agg(F.percentile_approx("at", shares, 4 * ranges)).first()[0] if shares else []
    bounds = sorted({least, *inner})

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(bounds, np.int64)
        for batch in batches:
            at = batch.column(0).to_numpy()
            part = np.searchsorted(edges, at, "right") - 1
            head = edges[part] == at
            before = (part[head] - 1) % len(edges)
            twice = batch.take(pa.array(np.flatnonzero(head)))
            for source, of, tail in ((batch, part, 0), (twice, before, 1)):
                if source.num_rows:
                    columns = [pa.array(of.astype(np.int32)), pa.array(np.full(len(of), tail, np.int32)), *source.columns]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "tail", "at", "doc_id", "text"])

    dealt = in_tasks(rows.select("at", "doc_id", "text"), ranged, "part int, tail int, at long, doc_id long, text string")
    return dealt.repartition(len(bounds), "part").sortWithinPartitions("part", "tail", "at", "text")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Sketches of each text and of the text whose second half is replaced by the beginning of the next document.

    The order is that of ``doc_id``, rows without id first, equal ids by their text; the first row follows the last. A
    single row follows itself. Repeated rows follow each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        before = None
        for batch in batches:
            out: list[tuple] = []
            parts, tails, ids = (batch.column(k).to_pylist() for k in (0, 1, 3))
            for k, value in enumerate(batch.column(4)):
                if tails[k] and (before is None or before[1] or before[0] != parts[k]):
                    before = (parts[k], tails[k])
                    continue  # a further row at the end of a range
                text = value.as_py()
                count, kept = kept_hashes(text)
                sketch = written(text, count, kept)
                if before is not None and before[0] == parts[k] and not before[1]:
                    _, _, key, own, own_kept, own_sketch = before
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    edited_count, edited_kept = kept_hashes(edited)
                    edited_sketch = written(edited, edited_count, edited_kept)
                    out.append(
                        (
                            key,
                            len(own),
                            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                            own_sketch,
                            edited_sketch,
                            1.0 if own_sketch == edited_sketch else _likeness(own_kept, edited_kept),
                            1.0 if own_sketch == sketch else _likeness(own_kept, kept),
                        )
                    )
                before = (parts[k], tails[k], ids[k], text, kept, sketch)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_tasks(with_next(docs), run, schema)


QUERIES = {"op2_fingerprints": op2_fingerprints}
ORACLE: dict[str, str] = {}
