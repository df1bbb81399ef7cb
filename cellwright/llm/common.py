"""What the corpus operators share: reading the tables, row keys, word shingles and the split of labelled rows."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.session import cut, scratch_path

__all__ = ["cut", "scratch_path", "shuffles_freed", "delete_table", "table", "in_tasks", "held_out", "drawn", "row_key", "utf8", "word_spans", "word_codes", "shingle_codes"]

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def in_tasks(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package on the import path of the Python workers (where it is at the same place)."""
    environment = df.sparkSession.sparkContext.environment
    path = environment.get("PYTHONPATH", "")
    if _ROOT not in path.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [path, _ROOT]))
    return df.mapInArrow(run, schema)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it has ended, for what it gave is a written table by then.

    Nothing is lost to recovery: a running query keeps its files, and a later one begins at the tables.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a table that ``cut`` wrote to ``path`` and of which nothing more is read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether labels of the row are out of bounds: crc32 of the id as text, mod 3, is 1. A NULL id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def drawn(share: float, *columns: str) -> Column:
    """Whether a hash of the columns is in the first ``share`` of its range, in steps of 2^-63."""
    if share >= 1:
        return F.lit(True)
    return F.shiftrightunsigned(F.xxhash64(*columns), 1) < F.lit(int(share * 2**63))


def row_key(doc_id: Column, text: Column) -> Column:
    """A key of id and text together; rows that agree in both are one document to the operators that use it."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x += _M1
    x ^= x >> np.uint64(30)
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


#: The base of the polynomial word code, and its inverse modulo 2^64 (both odd).
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_letters = np.arange(256)
_letters[ord("A") : ord("Z") + 1] += 32
#: A code for every byte; A-Z have those of a-z.
_BYTE_CODES = mixed(_letters.astype(np.uint64) + np.uint64(1))
_IS_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, _INVERSE)):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            _powers[k] = np.cumprod(powers, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words between blanks (space, 0x09 to 0x0D)."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _IS_BLANK[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def word_codes(data: bytes, spans: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """64-bit codes of the words of UTF-8 text, A-Z taken as a-z.

    A word's code is a polynomial in its bytes, so that sums along the text give those of all its words at once.
    """
    starts, ends = word_spans(data) if spans is None else spans
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers_to(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[np.frombuffer(data, np.uint8)] * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] ^ mixed((ends - starts).astype(np.uint64)))


def ranged_codes(codes: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """One code for each run of words ``codes[first:stop]``, the same wherever the run stands."""
    power, inverse = _powers_to(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[: len(codes)], out=sums[1:])
    return mixed((sums[stop] - sums[first]) * inverse[first] ^ mixed((stop - first).astype(np.uint64)))


def utf8(value: pa.Scalar) -> bytes:
    """The bytes of a text from Arrow; NULL has none."""
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def shingle_codes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Codes of all runs of ``width`` words, in order; fewer words make one run, none make none."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        out = np.full(1, n, np.uint64)
        for w in words:
            out = mixed(out ^ w)
        return out
    runs = n - width + 1
    out = np.full(runs, width, np.uint64)
    for k in range(width):
        out = mixed(out ^ words[k : k + runs])
    return out
