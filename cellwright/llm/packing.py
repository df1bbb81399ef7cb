"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document longer than the capacity gives whole windows by itself. What is left of each document is cut into pieces
whose lengths are powers of two, and blocks of pieces are dealt to windows by differencing: the two partial partitions
with the largest imbalance are merged, the fullest windows of one with the emptiest of the other, until one partition
is left. If a window then exceeds the capacity, the block is dealt anew with one window more.

Blocks form inside a partition as its rows stream by, so nothing is shuffled and memory holds one block.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.bpe import Remembered, chunks, default_vocabulary
from cellwright.llm.common import in_tasks, table

CAPACITY = 1024
#: Windows of a block, about. More windows leave less padding (half a window per block) and cost more merging.
BLOCK_WINDOWS = 256


def difference(lengths: list[int], windows: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each piece, and the sum of each window, by Karmarkar-Karp differencing into ``windows`` parts."""
    n = len(lengths)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(windows, np.int64)
    sums: dict[int, np.ndarray] = {}
    queue = []
    for k, length in enumerate(lengths):
        first = np.zeros(windows, np.int64)
        first[0] = length
        sums[k] = first
        queue.append((-length, k))
    heapq.heapify(queue)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(queue) > 1:
        _, a = heapq.heappop(queue)
        _, b = heapq.heappop(queue)
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        node = n + len(made)
        made.append((a, b, order.astype(np.int32)))
        sums[node] = both
        heapq.heappush(queue, (int(both[-1] - both[0]), node))
    total = sums[queue[0][1]]
    placed: dict[int, np.ndarray] = {queue[0][1]: np.arange(windows)}
    for k in range(len(made) - 1, -1, -1):  # from the last merge back: where each slot of a part ended up
        a, b, order = made[k]
        at = placed.pop(n + k)
        slots = np.empty(windows, np.int64)
        slots[order] = at
        placed[a], placed[b] = slots, slots[::-1]
    return np.array([placed[k][0] for k in range(n)]), total


def deal(lengths: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """The window of each piece and the number of windows, none of which is over ``capacity``."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        where, sums = difference(lengths, windows)
        if sums.max(initial=0) <= capacity:
            return where, windows
        windows += 1


def power_pieces(length: int) -> list[int]:
    """Falling powers of two that add up to ``length``."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def pack_ids(rows: Iterator[tuple[object, bytes]], capacity: int, block_windows: int) -> Iterator[tuple]:
    """(id, start, ids of the piece as bytes, tokens of the document, window, offset) for documents of 4-byte ids."""
    window = itertools.count()
    block: list[tuple[object, int, bytes, int]] = []
    held = 0

    def settle() -> Iterator[tuple]:
        where, count = deal([len(piece[2]) // 4 for piece in block], capacity)
        names = [next(window) for _ in range(count)]
        filled = [0] * count
        for (key, start, ids, total), at in zip(block, where.tolist()):
            yield key, start, ids, total, names[at], filled[at]
            filled[at] += len(ids) // 4

    for key, ids in rows:
        total = len(ids) // 4
        whole = total // capacity * capacity
        for start in range(0, whole, capacity):
            yield key, start, ids[4 * start : 4 * (start + capacity)], total, next(window), 0
        start = whole
        for length in power_pieces(total - whole):
            block.append((key, start, ids[4 * start : 4 * (start + length)], total))
            start += length
        held += total - whole
        if held >= block_windows * capacity:
            yield from settle()
            block, held = [], 0
    if block:
        yield from settle()


class TokenBytes:
    """Token ids of a text as little-endian unsigned 32-bit numbers, by the rank file's vocabulary.

    The rank file and the tokenizer file hold one vocabulary; an added token in a text gets its own id.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        from cellwright.llm.bpe import Vocabulary

        vocabulary = Vocabulary(path)
        self.added, self.added_pattern = vocabulary.added, vocabulary.added_pattern
        ranks = {piece: i for i, piece in vocabulary.pieces.items() if i not in set(self.added.values())}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = Remembered(lambda c: np.array(encoding.encode_ordinary(c), "<u4").tobytes(), 600_000)

    def __call__(self, text: str) -> bytes:
        out = []
        for is_added, parts in chunks(text, self.added_pattern):
            out += [self.added[c].to_bytes(4, "little") for c in parts] if is_added else map(self.known.__getitem__, parts)
        return b"".join(out)


_encoders: dict[str, TokenBytes] = {}

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = 0,
    path: str | None = None,
    block_windows: int = BLOCK_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: where it starts in its document, its length and checksum, its sequence and offset there.

    Every document is its token ids and ``end_id``, so an empty or NULL text is one token. Repeated rows are packed as
    often as they come; NULL ids stay NULL. An empty table gives no rows. ``with_ids`` adds the ids of the piece.
    ``sequence_id`` is unique over the table: the number of the partition and a count inside it.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = TokenBytes(path)
        encode = _encoders[path]
        last = end_id.to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 32

        def rows() -> Iterator[tuple[object, bytes]]:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                for k, text in enumerate(batch.column(1)):
                    yield keys[k], encode(text.as_py()) + last

        pieces = pack_ids(rows(), capacity, block_windows)
        while part := list(itertools.islice(pieces, 20_000)):
            key, start, ids, total, window, offset = zip(*part)
            columns = [
                pa.array(key, pa.int64()),
                pa.array(start, pa.int64()),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array(total, pa.int64()),
                pa.array([base + w for w in window], pa.int64()),
                pa.array(offset, pa.int64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").tolist() for x in ids], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return in_tasks(texts, run, SCHEMA + (", ids array<long>" if with_ids else ""))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
ORACLE: dict[str, str] = {}
