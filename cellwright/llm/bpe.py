"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked list, decoding by vocabulary strings.

The vocabulary file is a parameter. It is read once per Python worker; texts are cut at pre-token boundaries, so that
what was found for a frequent piece of text serves again.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import in_tasks, table

# The split pattern of the byte-level tokenizer, with white space spelled out as the Unicode property.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# A single space between two visible characters always begins a pre-token.
_LONELY_SPACE = re.compile(r"(?<=\S) (?=\S)")
_UNEVEN_SPACE = re.compile(r"\s | \s|^ | $")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte: itself where printable in Latin-1, else the next letter from U+0100."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


class Vocabulary:
    """Tokens, merges and whole-text tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        back = {letter: byte for byte, letter in letters.items()}
        self.first = [ids[letters[b]] for b in range(256)]
        self.pieces: dict[int, bytes] = {i: bytes(back[c] for c in token) for token, i in ids.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        for content, i in self.added.items():
            self.pieces[i] = content.encode()
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        ids = [self.first[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        queue = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, made = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: one of the two symbols has been merged since
            ids[i], ids[j] = made, -1
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                found = merges.get((made, ids[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, made, ids[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((ids[h], made))
                if found:
                    heapq.heappush(queue, (found[0], h, ids[h], made, found[1]))
        return [i for i in ids if i >= 0]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings in a row, as text; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def chunks(text: str, added: re.Pattern | None) -> Iterator[tuple[bool, list[str]]]:
    """Parts of ``text`` between added tokens, each as chunks that no pre-token crosses; True marks an added token."""
    parts = added.split(text) if added is not None else [text]
    for k, part in enumerate(parts):
        if k % 2:
            yield True, [part]
        elif part:
            if _UNEVEN_SPACE.search(part):
                cuts = [0, *(m.start() for m in _LONELY_SPACE.finditer(part)), len(part)]
                yield False, [part[a:b] for a, b in zip(cuts, cuts[1:])]
            else:
                head, *rest = part.split(" ")
                yield False, [head, *(" " + x for x in rest)]


class Remembered(dict):
    """What ``make`` gives for a chunk, kept for short chunks until ``limit`` of them are there."""

    def __init__(self, make: Callable[[str], object], limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(SPLIT)
        self.words = Remembered(lambda w: self.vocabulary.encode_piece(w.encode("utf-8")))

    def chunk_ids(self, chunk: str) -> list[int]:
        words = self.words
        return [i for w in self.split.findall(chunk) for i in words[w]]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for is_added, found in chunks(text, self.vocabulary.added_pattern):
            for c in found:
                out += [self.vocabulary.added[c]] if is_added else self.chunk_ids(c)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.vocabulary.decode(ids)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded): every text as token ids, and these ids as text again. NULL counts as empty.

    Rows come back one for one, repeated ones as often as they are given; other columns are not read.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    return in_tasks(_texts(docs, id_col, text_col), run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, but the ids and the decoded text as SHA-256, and the number of ids."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        vocabulary = own.vocabulary

        def settle(ids: list[int]) -> tuple[int, str, str]:
            return len(ids), ",".join(map(str, ids)), vocabulary.decode(ids)

        known = Remembered(lambda c: settle(own.chunk_ids(c)))
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                found = []
                for is_added, parts in chunks(text, vocabulary.added_pattern):
                    found += [settle([vocabulary.added[c]]) for c in parts] if is_added else map(known.__getitem__, parts)
                counts.append(sum(f[0] for f in found))
                encoded.append(hashlib.sha256(",".join([f[1] for f in found]).encode()).hexdigest())
                decoded.append(hashlib.sha256("".join([f[2] for f in found]).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return in_tasks(_texts(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op4_bpe": op4_bpe}
ORACLE: dict[str, str] = {}
