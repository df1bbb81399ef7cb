"""Ranked search and its graph of shared term sets, beside a plain version."""

import math
import random
import re
from collections import Counter

import pytest

from cellwright.llm.lexical import ranked, shared_plan, terms


def plain_terms(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def plain_ranked(docs, items, k=10):
    found = [(d, Counter(plain_terms(t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n_docs, n_terms = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for d, c in found:
            m = 10 + 90 * c.total() * n_docs // n_terms
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(plain_terms(text))
                if c[t]
            )
            if s > 0:
                scores.append((-s, d is not None, d))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(scores[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcé9") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    text = lambda n: "".join(rng.choice(words).title() + rng.choice([" ", "\n", "-", "_", "."]) for _ in range(n))
    docs = [(i % 190, text(rng.randint(0, 40))) for i in range(200)] + [(None, text(30)), (500, None), (501, ""), (502, " .,\x7f"), (503, text(30_000))]
    docs += [docs[3]] * 15
    items = [(i, text(rng.randint(1, 25))) for i in range(30)]
    items += [(40, items[0][1]), (41, items[0][1] + " extra"), (42, None), (43, ""), (44, "nowhere"), items[1], (1, "a b c"), (None, "a")]
    return docs, items


@pytest.mark.parametrize("block", [256, 7])
def test_like_the_plain_version(spark, data, block):
    docs, items = data
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(5)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    found = sorted((tuple(r) for r in ranked(d, q, block_items=block).collect()), key=str)
    assert found == plain_ranked(docs, items)


def test_empty_tables(spark, data):
    docs, items = data
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    assert ranked(d.limit(0), q).count() == 0
    assert ranked(d, q.limit(0)).count() == 0
    assert ranked(d.where("text IS NULL"), q).columns == ["item_id", "rank", "doc_id", "score"]


def test_graph_gives_back_the_sets_with_fewer_sums():
    rng = random.Random(3)
    shared = [{f"s{k}{i}".encode() for i in range(12)} for k in range(4)]
    sets = [set().union(*rng.sample(shared, 2), {f"o{rng.randint(0, 50)}".encode() for _ in range(5)}) for _ in range(30)] + [set(), {b"alone"}]
    plan = shared_plan(sets)
    held = [set() for _ in range(plan.n_nodes)]
    for term, k in plan.vocabulary.items():
        held[plan.leaf_of[k]].add(term)
    for node, members in plan.members:
        for m in members:
            assert held[m] and not held[node] & held[m]
            held[node] |= held[m]
    for found, members in zip(sets, plan.items):
        assert set().union(*[held[m] for m in members]) == found
        assert sum(len(held[m]) for m in members) == len(found)
    sums = sum(map(len, plan.items)) + sum(len(m) for _, m in plan.members) + len(plan.vocabulary)
    assert sums < sum(map(len, sets)) / 2


def test_terms():
    text = "Ab-\u00e9_\u00dc9\x00x\u00a0y\u2028z\u212a"
    assert [t.decode() for t in terms(text.encode())] == plain_terms(text) == ["ab", "\u00e9", "\u00dc9", "x\u00a0y\u2028z\u212a"]
