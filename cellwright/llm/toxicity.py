"""Toxicity: noisy-channel restoration of disguised words, then a lexical score of the restored text.

A character trigram model is counted over all documents. A word that is written with digits and signs, with repeated
letters or with separators becomes a lattice of what each sign may stand for, and Viterbi search under the model
finds the likeliest word. Words of restored text that mark toxic rows are learned from labels that may be used, and a
logistic model turns a document's marked words into a chance.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import drawn, held_out, in_tasks, table

# Letters that digits and signs are written for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Letters of the model: the most frequent ones. Others end a word for it.
ALPHABET = 64
#: Labelled documents to learn from, about (at most twice as many).
SAMPLE_ROWS = 20_000
#: A word marks toxicity if it is in so many toxic rows of the sample, and by so many standard errors in more than by chance.
LEAST_ROWS, LEAST_Z, LEAST_LIFT = 4, 5.0, 2.0
THRESHOLD = 0.7
# Natural logs of what the channel charges for a sign read as a letter, for a sign left out, and for a run cut short.
SIGN_COST, SKIP_COST, RUN_COST = -1.0, -1.5, -0.5

_LETTERS = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
_RUN = re.compile(r"(.)\1\1")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”‘’«»…–—¿¡"
_CUT = re.compile(r"[^\w$@!|+]+|_+")


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, n): letters, pairs and triples of letters of all words of all texts; ^ and $ stand for their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams: dict[str, int] = defaultdict(int)

        def settle() -> None:
            for word, n in words.items():
                marked = f"^^{word}$"
                for k in range(2, len(marked)):
                    grams[marked[k]] += n
                    grams[marked[k - 1 : k + 1]] += n
                    grams[marked[k - 2 : k + 1]] += n
            words.clear()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["gram", "n"])
            grams.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                words.update(_LETTERS.findall((text.as_py() or "").lower()))
                if len(words) > 200_000:
                    settle()
                    if len(grams) > 500_000:
                        yield out()
        settle()
        yield out()

    counted = in_tasks(docs.select("text"), run, "gram string, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


class LetterModel:
    """Interpolated trigram log-probabilities over a bounded alphabet."""

    def __init__(self, letters: str, grams: dict[str, int]):
        self.letters = letters
        at = {c: k for k, c in enumerate("^$" + letters)}
        n = len(at)
        one, two, three = np.zeros(n), np.zeros((n, n)), np.zeros((n, n, n))
        for gram, count in grams.items():
            if all(c in at for c in gram):
                (one, two, three)[len(gram) - 1][tuple(at[c] for c in gram)] = count
        p1 = (one + 1) / (one.sum() + n)
        p2 = (two + 4 * p1) / (two.sum(1, keepdims=True) + 4)
        p3 = (three + 8 * p2[None]) / (three.sum(2, keepdims=True) + 8)
        self.at, self.logs = at, np.log(p3).astype(np.float32)

    def restore(self, token: str) -> str:
        """The likeliest word behind ``token``; '' if nothing in it can be a letter."""
        at, logs = self.at, self.logs
        beam: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        n, k = len(token), 0
        while k < n:
            c, end = token[k], k + 1
            while end < n and token[end] == c:
                end += 1
            run = end - k
            arcs: list[tuple[str, float]] = []
            for letter in LEET.get(c, c):
                if letter in at and letter not in "^$":
                    cost = 0.0 if letter == c else SIGN_COST
                    arcs += [(letter, cost + RUN_COST * (run > 1)), (letter * 2, cost + RUN_COST * (run > 2))] if run > 1 else [(letter, cost)]
            if not arcs or (c in LEET and not c.isdigit()):
                arcs.append(("", SKIP_COST))
            later: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, word) in beam.items():
                for letters, cost in arcs:
                    x, y, total = a, b, score + cost
                    for letter in letters:
                        z = at[letter]
                        total += float(logs[x, y, z])
                        x, y = y, z
                    if (x, y) not in later or total > later[x, y][0]:
                        later[x, y] = (total, word + letters)
            beam, k = later, end
        end_at = at["$"]
        return max((score + float(logs[a, b, end_at]), word) for (a, b), (score, word) in beam.items())[1]


def letter_model(docs: DataFrame) -> LetterModel:
    """The model of all texts of ``docs``. At most (ALPHABET + 2) cubed counts come to the driver."""
    grams = count_grams(docs).persist()
    top = grams.where((F.length("gram") == 1) & ~F.col("gram").isin("^", "$")).orderBy(F.col("n").desc(), "gram").limit(ALPHABET).collect()
    letters = "".join(sorted(r["gram"] for r in top))
    known = grams.where(F.length(F.translate("gram", "^$" + letters, "")) == 0).collect()
    grams.unpersist()
    return LetterModel(letters, {r["gram"]: r["n"] for r in known})


class Restorer(dict):
    """Words behind a token, remembered for short tokens."""

    def __init__(self, model: LetterModel, limit: int = 300_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, token: str) -> tuple[str, ...]:
        bare = token.strip(_EDGES)
        lead = token[: len(token) - len(token.lstrip(_EDGES))]
        found: tuple[str, ...] = ()
        if bare.isalpha() and not _RUN.search(bare) and not (lead and lead[-1] in LEET):
            found = (bare,)
        elif any(c.isalpha() for c in token):
            tail = token[: len(token.rstrip(_EDGES))]
            kept = tail[len(lead) - 1 :] if lead and lead[-1] in LEET else bare
            parts = [p for p in _CUT.split(bare) if len(p) > 1 and p.isalpha()]
            found = tuple(dict.fromkeys([*parts, self.model.restore(kept), self.model.restore(bare)]))
        if len(self) >= self.limit:
            self.clear()
        if len(token) <= 64:
            self[token] = found
        return found

    def words(self, text: str) -> tuple[list[tuple[str, ...]], list[str]]:
        """What stands behind each token of a lower-cased text, and the words spelled with spaces."""
        spaced = [self.model.restore(m.group().replace(" ", "")) for m in _SPACED.finditer(text)]
        return list(map(self.__getitem__, text.split())), spaced


def marks(word: str) -> list[str]:
    """The word and its beginnings of three to six letters; a hyphen stands for what follows."""
    return [word, *(word[:k] + "-" for k in range(3, min(7, len(word))))] if word else []


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of about ``rows`` labelled documents that are not held out; the labels are the bounded side."""
    usable = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    count = usable.count()
    chosen = usable.where(drawn(min(1.0, rows / max(count, 1)), "doc_id")).limit(2 * rows)
    if count and not chosen.head(1):
        raise ValueError(f"none of {count} labelled rows were drawn to learn from")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """The letter model of all texts, the marked words and the logistic weights."""
    letters = letter_model(docs)
    sample = labelled_sample(docs, labels, sample_rows)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(letters)
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                tokens, spaced = restorer.words((text.as_py() or "").lower())
                words = sorted({m for ws in {*tokens, *((w,) for w in spaced)} for w in ws for m in marks(w)})
                columns = [pa.array(["", *words], pa.string()), pa.array([toxic.as_py()] * (len(words) + 1), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["word", "toxic"])

    seen = in_tasks(sample, presence, "word string, toxic int").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    # At most as many words can be in LEAST_ROWS toxic rows as the sample has words; common ones only are kept.
    totals = seen.where("word = ''").first()
    model = {"letters": letters, "marked": {}, "weights": None, "base": 0.5}
    if totals is None or not 0 < totals["t"] < totals["n"]:
        model["base"] = float(totals["t"]) / totals["n"] if totals else 0.0
        return model
    n, t = totals["n"], totals["t"]
    rate = t / n
    expected = F.col("n") * rate
    z = (F.col("t") - expected) / F.sqrt(expected * (1 - rate))
    marked = seen.where((F.col("word") != "") & (F.col("t") >= LEAST_ROWS) & (F.col("t") >= LEAST_LIFT * expected) & (z >= LEAST_Z))
    model["marked"] = {r["word"]: math.log((r["t"] + 0.5) / (t + 1)) - math.log((r["n"] - r["t"] + 0.5) / (n - t + 1)) for r in marked.orderBy(F.col("t").desc(), "word").limit(10_000).collect()}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, scorer = Restorer(letters), Scorer(model)
        for batch in batches:
            rows = [scorer.features(restorer, t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    # Rows with equal features are one weighted row, so an id that comes often adds nothing to what is collected.
    found = in_tasks(sample, features, "x array<double>, toxic int").groupBy("x", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    found = sorted((r["x"], r["toxic"], r["n"]) for r in found)  # sums must not depend on the order of tasks
    model["weights"] = logistic(*(np.array(c, float) for c in zip(*found)))
    return model


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights, the intercept first, by Newton's method with a small ridge, for rows that count ``n`` times."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w))
    keep[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + keep, x.T @ (n * (y - p)) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scorer:
    def __init__(self, model: dict):
        self.marked, self.weights, self.base = model["marked"], model["weights"], model["base"]
        self.known: dict[tuple[str, ...], tuple[float, str] | None] = {}

    def hit(self, words: tuple[str, ...]) -> tuple[float, str] | None:
        """The strongest mark behind a token."""
        if words not in self.known:
            if len(self.known) >= 300_000:
                self.known.clear()
            self.known[words] = max(((self.marked[m], m) for w in words for m in marks(w) if m in self.marked), default=None)
        return self.known[words]

    def features(self, restorer: Restorer, text: str | None) -> list[float]:
        """Whether, how many and how strong the marks are, how many tokens carry one, and which share of all tokens."""
        tokens, spaced = restorer.words((text or "").lower())
        hits = list(filter(None, map(self.hit, tokens))) + list(filter(None, (self.hit((w,)) for w in spaced)))
        distinct = dict((mark, weight) for weight, mark in hits)
        return [
            float(bool(distinct)),
            float(min(len(distinct), 4)),
            max(distinct.values(), default=0.0),
            math.log1p(sum(distinct.values())),
            math.log1p(len(hits)),
            math.log1p(100 * len(hits) / max(len(tokens), 1)),
        ]

    def score(self, restorer: Restorer, text: str | None) -> float:
        if self.weights is None:
            return self.base
        z = float(self.weights[0] + np.dot(self.weights[1:], self.features(restorer, text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score_documents(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row, from its whole text alone; NULL and empty texts score as texts without marked words.

    Without usable labels of both kinds every row gets the share of toxic labels, or 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, scorer = Restorer(model["letters"]), Scorer(model)
        for batch in batches:
            scores = [scorer.score(restorer, t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                ["doc_id", "score", "predicted"],
            )

    return in_tasks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE: dict[str, str] = {}
