"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

Every labelled row is learnt from. A hash deals the rows to shards, which tasks train apart and from the same beginning. The
product of embeddings and softmax weights is one small table, and a document's score is the mean of table rows over its
subwords. So a shard's scores are linear in its table, and the model is the mean of the tables, weighted by their rows; the
driver gets this one table. Scores are calibrated by a temperature on all rows that the hash keeps out of training, and so
is the score below which a prediction is rejected. Sums are of whole numbers, so no result depends on how rows lie.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import cut, held_out, in_tasks, mixed, ranged_codes, shuffles_freed, table

#: Rows that are trained together, about, and the share of labelled rows for calibration.
SHARD_ROWS, CALIBRATION = 3000, 0.25
#: A shard whose bucket counts take more bytes is trained in several parts.
SHARD_BYTES = 1 << 25
#: Tables and losses are summed in steps of one part in UNIT; their slices are sent by so many buckets.
UNIT, SLICE = 1 << 20, 1024
BUCKETS, DIMENSIONS, EPOCHS, RATE = 1 << 14, 16, 6, 0.5
#: Share of rightly labelled calibration rows that the rejection may cost, and the highest score that it may ask for.
REJECTED, REJECT_BELOW = 0.002, 0.5
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none if the text has no letter."""
    found = _WORD.findall((text or "").lower())
    return found if any(c.isalpha() for w in found for c in w) else []


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its runs of two to four letters, its ends marked, and the number of the word of each."""
    letters = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    stop, number = lengths.cumsum(), np.arange(len(words))
    of = np.repeat(number, lengths)
    left = np.repeat(stop, lengths) - np.arange(len(letters))  # letters of the word from here on
    codes, owners = [ranged_codes(letters, stop - lengths, stop)], [number]
    run = mixed(letters)
    for n in (2, 3, 4):
        run = mixed(run[:-1] ^ letters[n - 1 :])
        whole = left[: len(run)] >= n
        codes.append(run[whole])
        owners.append(of[: len(run)][whole])
    return (np.concatenate(codes) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(owners)


class WordRows(dict):
    """Sums of ``table`` rows over a word's subwords and their number, by word, in one array that is emptied when full."""

    def __init__(self, table: np.ndarray, limit: int = 300_000):
        super().__init__()
        self.table, self.limit = table, limit
        self.rows = np.zeros((limit, table.shape[1] + 1))

    def learn(self, words: list[str]) -> None:
        """Add words that are not yet here."""
        buckets, owners = subwords(words)
        at, n = len(self), len(words)
        for k in range(self.table.shape[1]):
            self.rows[at : at + n, k] = np.bincount(owners, self.table[buckets, k], n)
        self.rows[at : at + n, -1] = np.bincount(owners, minlength=n)
        self.update(zip(words, range(at, at + n)))

    def mean(self, words: list[str]) -> np.ndarray:
        """The mean of the table rows over all subwords of ``words``."""
        total = np.zeros(self.table.shape[1] + 1)
        for start in range(0, len(words), self.limit // 4):
            part = words[start : start + self.limit // 4]
            if len(self) + len(part) > self.limit:
                self.clear()
            unseen = [w for w in dict.fromkeys(part) if w not in self]
            if unseen:
                self.learn(unseen)
            total += self.rows[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(0)
        return total[:-1] / max(total[-1], 1.0)


class WordBuckets(dict):
    """Buckets of a word's subwords, by word; emptied when full."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def counts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of all subwords and how often each occurs."""
        often = Counter(words)
        if len(self) + len(often) > self.limit:
            self.clear()
        unseen = [w for w in often if w not in self]
        if unseen:
            buckets, owners = subwords(unseen)
            buckets = buckets[np.argsort(owners, kind="stable")].astype(np.uint16)
            self.update(zip(unseen, np.split(buckets, np.cumsum(np.bincount(owners))[:-1])))
        found = [self[w] for w in often]
        if not found:
            return np.zeros(0, np.uint16), np.zeros(0, np.int32)
        times = np.repeat(np.fromiter(often.values(), np.int64, len(often)), np.fromiter(map(len, found), np.int64, len(found)))
        counts = np.bincount(np.concatenate(found), times, BUCKETS)
        at = np.flatnonzero(counts)
        return at.astype(np.uint16), counts[at].astype(np.int32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: int) -> tuple[np.ndarray, np.ndarray]:
    """The table of bucket scores and the bias from (number of the language, buckets, counts), rows with buckets only."""
    rng = np.random.default_rng(11)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    rows = [(y, at.astype(np.intp), (counts / counts.sum()).astype(np.float32)) for y, at, counts in rows]
    weights, bias = np.zeros((DIMENSIONS, languages)), np.zeros(languages)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for k in rng.permutation(len(rows)):
            y, at, share = rows[k]
            taken = embedding.take(at, 0)
            hidden = share @ taken
            error = softmax(hidden @ weights + bias)
            error[y] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= rate * 0.1 * error
            taken -= np.multiply.outer(share, (rate * 20 * back).astype(np.float32))
            embedding[at] = taken
    return embedding @ weights, bias


def _trained(rows: DataFrame, languages: list[str], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the tables and of the biases of all shards of (key, text, lang), weighted by their rows."""
    goal, width = {lang: k for k, lang in enumerate(languages)}, len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, size, last = WordBuckets(), [], 0, None
        sums, learnt = np.zeros((BUCKETS + 1, width), np.int64), 0

        def settle() -> None:
            nonlocal sums, learnt
            if held:
                scores, bias = train(held, width)
                sums += np.rint(np.vstack([scores, bias]) * (UNIT * len(held))).astype(np.int64)
                learnt += len(held)

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if row == last:
                    continue  # rows equal in all columns teach once
                if held and (row[0] != last[0] or size > SHARD_BYTES):
                    settle()
                    held, size = [], 0
                last = row
                at, counts = cache.counts(words_of(row[2]))
                if len(at):
                    held.append((goal[row[3]], at, counts))
                    size += at.nbytes + counts.nbytes
        settle()
        if learnt:
            parts = [sums[k : k + SLICE].tobytes() for k in range(0, len(sums), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([learnt] * len(parts)), pa.array(parts)], ["part", "n", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for part, n, sums in zip(*(column.to_pylist() for column in batch.columns)):
                total = found.setdefault(part, [0, 0])
                total[0] += n
                total[1] = total[1] + np.frombuffer(sums, np.int64)
        if found:
            of = sorted(found)
            columns = [pa.array(of, pa.int32()), pa.array([found[k][0] for k in of]), pa.array([found[k][1].tobytes() for k in of])]
            yield pa.RecordBatch.from_arrays(columns, ["part", "n", "sums"])

    schema = "part int, n long, sums binary"
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key", "lang", "text"), F.lit(shards)).cast("int"))
    # Tasks take whole shards, in one order wherever the rows lie.
    dealt = dealt.repartitionById(shards, "shard").select("shard", "key", "text", "lang").sortWithinPartitions("shard", F.xxhash64(F.lit(1), "key", "lang", "text"), "key", "lang", "text")
    with shuffles_freed(rows.sparkSession):
        parts = in_tasks(in_tasks(dealt, run, schema).repartition("part"), add, schema).orderBy("part").collect()
    if not parts:
        return np.zeros((BUCKETS, width)), np.zeros(width)
    mean = np.concatenate([np.frombuffer(p["sums"], np.int64) for p in parts]).reshape(-1, width) / (UNIT * parts[0]["n"])
    return mean[:-1], mean[-1]


def _calibrated(rows: DataFrame, model: dict) -> tuple[float, float]:
    """The temperature with the least loss on all of (key, text, lang), and the score below which a prediction is rejected."""
    goal, width = {lang: k for k, lang in enumerate(model["languages"])}, len(model["languages"])
    grid = np.geomspace(0.05, 20, 60)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordRows(model["table"])
        for batch in batches:
            found = [(goal[lang], words) for text, lang in zip(batch.column(0), batch.column(1).to_pylist()) if (words := words_of(text.as_py()))]
            logits = [(known.mean(words) + model["bias"]).tobytes() for _, words in found]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in found], pa.int32()), pa.array(logits, pa.binary())], ["goal", "logits"])

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, width)

    def lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            goals, logits = read(batch)
            losses = [-np.log(softmax(logits / t)[np.arange(len(goals)), goals] + 1e-12) for t in grid]
            sums = [int(np.rint(x * UNIT).sum()) for x in losses]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array(sums, pa.int64())], ["at", "loss"])

    judged = cut(in_tasks(rows.select("text", "lang"), judge, "goal int, logits binary"), "calibration")
    losses = in_tasks(judged, lose, "at int, loss long").groupBy("at").agg(F.sum("loss").alias("loss")).orderBy("loss", "at").head(1)
    if not losses:
        return 1.0, 0.0
    temperature = float(grid[losses[0]["at"]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            goals, logits = read(batch)
            chance = softmax(logits / temperature)
            yield pa.RecordBatch.from_arrays([pa.array(chance.max(1)[chance.argmax(1) == goals], pa.float64())], ["score"])

    # Rounded, the scores are few values, however many rows there are.
    right = in_tasks(judged, score, "score double").agg(F.percentile(F.round("score", 5), F.lit(REJECTED)).alias("least")).first()["least"]
    return temperature, 0.0 if right is None else min(float(right), REJECT_BELOW)


def fit(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> dict:
    """Learn from all rows with a language that are not held out, about ``shard_rows`` of them together.

    The model has the languages, the table of bucket scores, bias, temperature and threshold.
    """
    labelled = docs.select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.where(~held_out(F.col("key")) & F.col("lang").isNotNull())
    counted = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    count, languages = sum(counted.values()), sorted(counted)
    model = {"languages": languages, "table": np.zeros((BUCKETS, len(languages))), "bias": np.zeros(len(languages)), "temperature": 1.0, "reject": 0.0}
    if not count:
        return model
    if shard_rows < 1:
        raise ValueError(f"none of {count} labelled rows can be drawn into shards of {shard_rows} rows")
    # A few rows are all learnt from.
    apart = F.pmod(F.xxhash64(F.lit(2), "key", "lang", "text"), F.lit(1 << 20)) < F.lit(int(CALIBRATION * (1 << 20) if count >= 20 else 0))
    model["table"], model["bias"] = _trained(labelled.where(~apart), languages, max(1, round(count * (1 - CALIBRATION) / shard_rows)))
    if count >= 20:
        model["temperature"], model["reject"] = _calibrated(labelled.where(apart), model)
    return model


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with ``lang_pred``, ``score`` and ``rejected``, beside ``doc_id`` and ``text``, one for one.

    Texts without a letter (NULL, empty, signs only) are ``und`` with score 0 and rejected; a model without languages
    rejects all. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    return in_tasks(texts, _predictor(model, 1), _with(texts, "lang_pred string, score double, rejected boolean"))


def _with(rows: DataFrame, more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [more])


def _predictor(model: dict, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = WordRows(model["table"])
        for batch in batches:
            langs, scores, rejected = [], [], []
            for value in batch.column(text_at):
                words = words_of(value.as_py())
                if not words or not model["languages"]:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                chance = softmax((rows.mean(words) + model["bias"]) / model["temperature"])
                best = int(chance.argmax())
                langs.append(model["languages"][best])
                scores.append(float(chance[best]))
                rejected.append(bool(chance[best] < model["reject"]))
            added = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return run


def drop_rejected(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` without the rows whose language is rejected, all columns as they were."""
    names = docs.columns
    kept = docs.select(F.struct("*").alias("row"), docs["text"].alias("text"))
    judged = in_tasks(kept, _predictor(model, 1), _with(kept, "lang_pred string, score double, rejected boolean"))
    return judged.where(~F.col("rejected")).select(*(F.col("row").getField(n).alias(n) for n in names))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op9_langid": op9_langid}
ORACLE: dict[str, str] = {}
