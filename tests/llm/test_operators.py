"""The corpus operators on small tables: nulls, empty and long texts, ties, repeated rows, clashing names, brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellwright.llm import bpe, fingerprints, jaccard, langid, line_dedup, neighbours, packing, sharding, substring_dedup, toxicity
from cellwright.llm.common import drawn, held_out
from cellwright.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base, passage = words(rng, 120), ". ".join(words(rng, 9) for _ in range(9)) + "."
    near = base.split()
    near[3] = "changed"
    out = [
        (1, base, "en", "s"), (2, base, "en", "s"), (2, base, "en", "s"), (3, " ".join(near), "de", "s"), (None, words(rng, 30), "en", None),
        (5, None, None, "s"), (6, "", "en", "s"), (7, "  \n\t ", "en", "s"), (8, "one two", "en", "s"), (9, "ONE\ttwo", "fr", "s"),
        (10, words(rng, 40) + ". " + passage + " " + words(rng, 40), "en", "s"), (11, words(rng, 40) + ". " + passage + " " + words(rng, 50), "en", "s"),
        (12, "word " * 40_000, "en", "s"), (13, "x" * 50_000, "en", "s"), (14, "<|endoftext|> 12 é 你好 !!!", "en", "s"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Columns with names that the operators use inside.
    more = {c: F.lit(c) for c in ("row", "key", "id", "places", "gone", "wanted_id", "removed_chunks", "kept_in", "cleaned", "at")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(more).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_empty_tables(spark, none):
    assert line_dedup.remove_repeats(none).count() == 0
    assert fingerprints.compare_edited(none).count() == 0
    assert sharding.shard_documents(none).count() == 0
    assert bpe.encode_digests(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert jaccard.near_groups(none).count() == 0
    assert substring_dedup.remove_passages(none).count() == 0
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_documents(none, toxicity.fit(none, labels)).count() == 0


def test_line_chunks_join_to_the_text_and_repeats_go(spark, docs):
    whole = docs.where("text IS NOT NULL").select("text", F.array_join(F.transform(line_dedup.chunks(F.col("text")), lambda c: c["chunk"]), "\n").alias("again"))
    assert whole.where("text <> again").count() == 0
    rng = random.Random(1)
    block = [words(rng, 8) for _ in range(12)]
    texts = ["\n".join([*(words(rng, 8) for _ in range(k)), *block, words(rng, 8)]) for k in range(4)] + ["\n".join(words(rng, 8) for _ in range(9))]
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)] + [(9, None, 9)], "doc_id long, text string, key int")
    got = {r["doc_id"]: r for r in line_dedup.remove_repeats(df).collect()}
    assert got[0]["text"] == texts[0] and got[4]["text"] == texts[4] and got[9]["text"] is None and got[1]["key"] == 1
    for k in (1, 2, 3):
        left = got[k]["text"].split("\n")
        assert got[k]["removed_chunks"] > 0 and set(left) <= set(texts[k].split("\n")) and sum(b in left for b in block) < 8
    assert line_dedup.remove_repeats(docs).columns == [*(c for c in docs.columns if c != "removed_chunks"), "removed_chunks"]


def test_fingerprints(docs, rows):
    got = fingerprints.compare_edited(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1] or ""))
    wanted = collections.Counter()
    for a, b in zip(order, order[1:] + order[:1]):
        own, n = a[1] or "", len(a[1] or "")
        wanted[a[0], n, hashlib.sha256((own[: n - n // 2] + (b[1] or "")[: n // 2]).encode()).hexdigest()] += 1
    assert wanted == collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got)
    rng = random.Random(2)
    a, b = words(rng, 3000), words(rng, 3000)
    one, both = fingerprints.fingerprint(a), fingerprints.merge([fingerprints.fingerprint(a), fingerprints.fingerprint(b)])
    assert fingerprints.containment(one, both) == 1.0 and abs(fingerprints.likeness(one, both) - 0.5) < 0.05
    assert fingerprints.fingerprint(None) == fingerprints.fingerprint("") and fingerprints.likeness(one, one) == 1.0


def test_best_fit_decreasing_against_a_plain_search():
    rng = random.Random(3)
    for _ in range(30):
        sizes, capacity = [rng.randint(1, 60) for _ in range(40)], 60
        rooms, plain = [], [0] * len(sizes)
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            fits = [(r, b) for b, r in enumerate(rooms) if r >= sizes[k]]
            b = min(fits)[1] if fits else len(rooms)
            rooms += [] if fits else [capacity]
            rooms[b] -= sizes[k]
            plain[k] = b
        assert sharding.best_fit_decreasing(sizes, capacity) == plain
    sizes = [1000, *[rng.randint(1, 9) for _ in range(500)]]
    where = sharding.even_bins(sizes, 4)
    loads = [sum(s for s, w in zip(sizes, where) if w == b) for b in range(4)]
    assert loads[0] == 1000 and max(loads[1:]) - min(loads[1:]) <= 9


def test_shards(docs, rows):
    got = sharding.shard_documents(docs, 4).collect()
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 1 for _, t, *_ in rows)
    of = collections.defaultdict(set)
    slots = collections.defaultdict(list)
    for r in got:
        of[bytes(r["digest"])].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in of.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_bpe_is_the_library(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    wanted = collections.Counter()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        wanted[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert wanted == collections.Counter(tuple(r) for r in bpe.encode_digests(docs).collect())
    assert all(r["decoded"] == (dict((i, t) for i, t, *_ in rows)[r["doc_id"]] or "") for r in bpe.encode_documents(docs).collect())
    rng, own = random.Random(5), bpe.codec(bpe.default_vocabulary())
    signs = list("ab'sltdre Z09  \n\t\r\x1c\x85\xa0　一²éß😀.,!_-<>") + ["<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_packing_keeps_every_id_once(docs, rows):
    got = packing.pack_documents(docs, with_ids=True).collect()
    filled = collections.defaultdict(list)
    for r in got:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    encode = packing.TokenBytes(bpe.default_vocabulary())
    wanted = collections.Counter(t for _, text, *_ in rows for t in np.frombuffer(encode(text or ""), "<u4").tolist() + [0])
    assert wanted == collections.Counter(t for r in got for t in r["ids"])


def test_differencing_is_near_equal_and_opens_windows():
    rng = random.Random(6)
    lengths = [p for _ in range(200) for p in packing.power_pieces(rng.randint(1, 1023))]
    where, windows = packing.deal(lengths, 1024)
    sums = np.bincount(where, lengths, windows)
    assert sums.max() <= 1024 and sums.sum() == sum(lengths) and windows <= -(-sum(lengths) // 1024) + 1 and sums.max() - sums.min() < 64
    where, windows = packing.deal([600, 600, 600], 1024)
    assert windows == 3


def brute_components(texts):
    """Smallest id reachable by links, from all pairs."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {i: i for i in texts}

    def find(i):
        return i if up[i] == i else find(up[i])

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_jaccard_groups(spark, docs, rows, monkeypatch):
    got = jaccard.near_groups(docs).collect()
    assert len(got) == len(rows)
    wanted = brute_components({i: t for i, t, *_ in rows if i is not None})
    assert all((r["n_shingles"], r["component_id"]) == wanted[r["id"]] for r in got if r["id"] is not None)
    rng = random.Random(7)
    chains = {}
    for start in range(0, 120, 12):  # chains of near copies, some with a passage that all share
        text, shared = words(rng, 80).split(), words(rng, 25) if start % 24 else ""
        for k in range(12):
            text[rng.randrange(80)] = f"new{start}{k}"
            chains[start + k] = " ".join(text) + " " + shared
    monkeypatch.setattr(jaccard, "SLICE_CLASSES", 4)
    df = spark.createDataFrame(list(chains.items()), "doc_id long, text string").repartition(4)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(df).collect()} == brute_components(chains)


def test_keep_first(docs, rows):
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert [i for none, i in ids if not none] == [1, 5, 6, 7, 8, 10, 11, 12, 13, 14] and ids[-1][0]


def test_prefix_counts_hold_for_alike_sets():
    rng = random.Random(8)
    for _ in range(3000):
        n, extra = rng.randint(1, 60), rng.randint(0, 12)
        a = set(rng.sample(range(1000), n))
        b = set(rng.sample(sorted(a), max(1, n - rng.randint(0, 6)))) | set(rng.sample(range(1000, 2000), extra))
        if 100 * len(a & b) >= 80 * len(a | b):
            first = [set(sorted(s)[: int(jaccard.prefix_length(len(s)))]) for s in (a, b)]
            common = len(first[0] & first[1])
            assert common >= jaccard.least_shared(len(a)) and common >= jaccard.least_shared(len(b))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 2)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(900, 16)), 3)
    x[50:80] = x[40]
    table = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, [1.0]), (None, x[0].tolist()), (0, x[0].tolist())]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 900, 20))
    hits = total = 0
    for q, found in got.items():
        exact = sorted(((-(x[q] * x[v]).sum(), v) for v in range(900) if v != q))[:20]
        assert len(found) == 20 and all(abs(s - x[q] @ x[v]) < 1e-12 for v, s in found) and q not in dict(found)
        hits, total = hits + len({v for _, v in exact} & {v for v, _ in found}), total + 20
    assert hits >= 0.9 * total
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.nearest(few).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]


def test_substring_removal(spark, docs, rows):
    got = {r["doc_id"]: r for r in substring_dedup.remove_passages(docs).collect()}
    text = {i: t for i, t, *_ in rows}
    assert len(substring_dedup.remove_passages(docs).collect()) == len(rows)
    runs = {i: {tuple(t.split()[k : k + 6]) for k in range(len(t.split()) - 5)} for i, t in ((10, text[10]), (11, text[11]), ("left", got[11]["text"]))}
    assert runs[10] & runs[11] and got[10]["text"] == text[10] and not runs[10] & runs["left"] and got[11]["kept_in"] == [10]
    assert all(got[i]["text"] == text[i] for i in (1, 5, 6, 7, 8, 9, 13, 14, None))
    assert set(substring_dedup.remove_passages(docs).columns) == {*docs.columns, "removed_spans"}


def in_partitions(spark, texts):
    """(id, row, text) with every text in a partition of its own."""
    texts = list(enumerate(texts))
    return spark.createDataFrame(spark.sparkContext.parallelize([(k, k, t) for k, t in texts], len(texts)), "id long, row long, text string")


def test_paragraphs_do_not_depend_on_neighbouring_texts():
    rng = random.Random(21)
    texts = [words(rng, rng.choice([0, 1, 4, 7, 30, 300])).replace("e ", "e. ").replace("a ", "a\n").encode() for _ in range(60)] + [b"", b"x " * 500, b" "]
    rng.shuffle(texts)
    together = substring_dedup.Paragraphs(*texts)
    numbers, keys = substring_dedup.paragraph_keys(together)
    for k, text in enumerate(texts):
        alone = substring_dedup.Paragraphs(text)
        here, base = slice(together.from_[k], together.from_[k + 1]), together.words_from[k]
        first, stop = together.first[here], together.stop[here]
        assert (first - base).tolist() == alone.first.tolist() and (stop - base).tolist() == alone.stop.tolist()
        assert together.wide[here].tolist() == alone.wide.tolist()
        own, own_keys = substring_dedup.paragraph_keys(alone)
        mine = (numbers >= here.start) & (numbers < here.stop)
        assert (numbers[mine] - here.start).tolist() == own.tolist() and keys[mine].tolist() == own_keys.tolist()
        zeros = [0] * len(first)
        for a, b in zip(together.reach(first, stop, np.array(zeros, int) + k), alone.reach(alone.first, alone.stop, np.array(zeros, int))):
            assert (a - base).tolist() == b.tolist()


def test_agreement_counts_words_from_the_beginning():
    rng = np.random.default_rng(3)
    rows = [[rng.integers(0, 2, rng.integers(0, 6)).astype(np.uint32) for _ in range(200)] for _ in range(2)]
    wanted = [next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))) for x, y in zip(*rows)]
    a, b = (pa.array([x.tobytes() for x in column], pa.binary()) for column in rows)
    assert substring_dedup._agreement(a, b).tolist() == wanted
    assert substring_dedup._agreement(a[50:90], b[50:90]).tolist() == wanted[50:90]


def test_bands_keep_every_class_that_meets_another(spark):
    rng = random.Random(11)
    passages = [words(rng, 60).split() for _ in range(12)]
    texts = []
    for p in passages:
        near = list(p)
        near[0] = "changed"
        texts += [" ".join(p)] * 3 + [" ".join(near)] * 2
    classes = collections.defaultdict(set)
    for t in texts:
        found = substring_dedup.Paragraphs(t.encode())
        long, keys = substring_dedup.paragraph_keys(found, wide=True)
        for key, bands in zip(keys.tolist(), substring_dedup.band_codes(found, long).reshape(-1, substring_dedup.BANDS).tolist()):
            for b in bands:
                classes[b].add(key)
    wanted = sorted((b, k) for b, keys in classes.items() if len(keys) > 1 for k in keys)
    for size in (10_000, 3):  # also with groups that go on in the next batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = sorted(tuple(r) for r in substring_dedup._bands(in_partitions(spark, texts)).collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert wanted and got == wanted


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    """All alike pairs of a bucket of many slices are linked, though none is like the hub and all share most shingles."""
    monkeypatch.setattr(substring_dedup, "BLOCK_CLASSES", 4)
    rng = random.Random(12)
    common, bodies, sets = [rng.getrandbits(64) for _ in range(92)], [], {}
    for _ in range(40):
        own = [rng.getrandbits(64) for _ in range(4)]
        for _ in range(2):
            body = np.array([*common, *own, *(rng.getrandbits(64) for _ in range(8))], np.uint64)
            key = rng.getrandbits(62)
            sets[key] = set(substring_dedup.shingle_codes(body).tolist())
            bodies.append((key, bytearray(body.tobytes())))
    bodies = spark.createDataFrame(bodies, "key long, body binary")
    bands = bodies.select(F.lit(5).cast("long").alias("bucket"), "key")
    got = {r["node"]: r["component"] for r in components(substring_dedup._near_classes(bands, bodies)).collect()}
    alike = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(alike) == 40 and len(got) == 80 and all(got[a] == got[b] == a for a, b in alike)


def test_jaccard_blocks_are_bounded(spark, monkeypatch):
    """No task holds more than two slices of a block, and rows equal in id and text are there once."""
    monkeypatch.setattr(jaccard, "SLICE_CLASSES", 4)
    rng = random.Random(13)
    kept, base = words(rng, 30), {k: words(rng, 20) for k in range(60)}
    texts = [(k, base[k] + " " + kept + (" more" if k % 2 else "")) for k in range(60)] + [(3, base[3] + " " + kept + " more")] * 40
    rows = spark.createDataFrame(texts, "id long, text string").withColumn("row", F.xxhash64("id", "text")).repartition(3)
    seen = []
    real = jaccard._block_edges
    monkeypatch.setattr(jaccard, "_block_edges", lambda blocks, *more: seen.append(blocks.groupBy("block", "slice", "other").count().collect()) or real(blocks, *more))
    reps = rows.select(F.col("id").alias("key"), "id", "row").distinct()
    members = reps.select(F.lit(1).cast("long").alias("block"), F.lit(0).cast("long").alias("hub"), "key")
    jaccard.sliced_links(members, lambda placed: jaccard._with_texts(rows, placed, reps), jaccard._read_text, jaccard.SLICE_CLASSES).collect()
    sizes = [r["count"] for rows in seen for r in rows]
    assert len(seen) == 2 and max(sizes) <= 30  # slices are dealt by hash: about four, some have more


def test_passages_without_sentence_ends_go_whole(spark):
    """Copied runs of 50 to 200 words in unpunctuated text, over several partitions: no word of the copy stays."""
    rng = random.Random(14)
    lengths, texts, parts = [50, 60, 80, 200], [], []
    for n in lengths * 10:
        passage = words(rng, n)
        parts.append([(words(rng, 60), passage, words(rng, 60)) for _ in range(2)])
        texts += [" ".join(t) for t in parts[-1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_passages(df).collect()}
    assert all(got[2 * k] == texts[2 * k] for k in range(len(parts)))
    whole = sum(got[2 * k + 1] == " ".join(second[::2]) for k, (_, second) in enumerate(parts))
    assert whole >= len(parts) - 1  # one run in 300 of 50 words has no whole paragraph


def test_few_sets_link_as_many_do():
    """Blocks of a few sets, which are held against one another, give the components that the tree gives."""
    rng, linked = np.random.default_rng(5), 0
    for _ in range(300):
        base = np.arange(rng.integers(0, 30), dtype=np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(100, 200, rng.integers(0, 4)).astype(np.uint64)])) for _ in range(rng.integers(2, jaccard.FEW_SETS + 1))]
        more = [np.array([1000 + k], np.uint64) for k in range(jaccard.FEW_SETS + 1)]  # like nothing else; with these it is the tree that links
        pick = None if rng.random() < 0.5 else lambda a, b: (a + b) % 2 == 1
        few, tree = jaccard.link_block(sets, pick)[0], jaccard.link_block(sets + more, pick)[0]
        assert [few.find(k) for k in range(len(sets))] == [tree.find(k) for k in range(len(sets))]
        linked += any(few.find(k) != k for k in range(len(sets)))
    assert 30 < linked < 300


def test_passages_go_from_many_texts_at_a_time(spark):
    """Texts of a batch are cut together; spans count from the text's own beginning, and each text loses its own passage."""
    rng = random.Random(33)
    passages = [words(rng, 90) for _ in range(20)]
    texts = [f"{words(rng, 30)} Ö. {p}. {words(rng, 30)}" for p in passages] + [f"{words(rng, 25)} Ü. {p}. {words(rng, 35)}" for p in passages]
    df = spark.createDataFrame([*enumerate(texts), (40, None), (41, "")], "doc_id long, text string").repartition(1)
    got = {r["doc_id"]: r for r in substring_dedup.remove_passages(df).collect()}
    assert got[40]["text"] is None and got[41]["text"] == ""
    for k, p in enumerate(passages):
        first, second = got[k], got[20 + k]
        assert first["text"] == texts[k] and not first["removed_spans"] and second["kept_in"] == [k] and p not in second["text"]
        (start, end), = second["removed_spans"]
        assert p in texts[20 + k].encode()[start:end].decode() and end - start < len(texts[20 + k]) - 150


def test_small_shares_are_drawn(spark):
    assert 0 < spark.range(20_000_000).where(drawn(5e-7, "id")).count() < 40
    assert spark.range(1000).where(drawn(1.0, "id")).count() == 1000
    taught = spark.createDataFrame([(k, f"word {k}", "en", k % 2) for k in range(30)], "doc_id long, text string, lang string, toxic int")
    for fit in (lambda: langid.fit(taught, 0), lambda: toxicity.fit(taught, taught.select("doc_id", "toxic"), 0)):
        with pytest.raises(ValueError, match="drawn"):
            fit()


def test_language(spark, docs):
    taught = spark.createDataFrame(
        [(k, ("the cat and the dog were here " if k % 2 else "der Hund und die Katze waren hier ") * 3 + str(k), "en" if k % 2 else "de") for k in range(300)],
        "doc_id long, text string, lang string",
    )
    model = langid.fit(taught)
    judged = langid.predict(taught, model).join(taught.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id")))
    assert judged.where("lang <> lang_pred").count() == 0 and judged.count() > 50
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] for i in (5, 6, 7)) and all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.drop_rejected(docs, model)
    assert kept.columns == docs.columns and not {5, 6, 7} & {r["doc_id"] for r in kept.collect()}


def test_language_is_learnt_from_every_row(spark):
    """In shards of a hundred rows every one of forty languages is learnt, two are told apart, and the model is the same however the rows lie."""
    rng = random.Random(21)
    vocabulary = [["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(12)] for _ in range(40)]
    rows = [(k, " ".join(rng.choices(vocabulary[k % 40], k=40)), f"l{k % 40:02d}") for k in range(600)]
    taught = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, other = langid.fit(taught, 100), langid.fit(taught.repartition(7), 100)
    assert one["languages"] == [f"l{k:02d}" for k in range(40)]
    assert np.array_equal(one["table"], other["table"]) and one["temperature"] == other["temperature"] and one["reject"] == other["reject"]
    two = taught.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "the cat and the dog were here").otherwise("der Hund und die Katze waren hier").alias("text"), (F.col("doc_id") % 2).cast("string").alias("lang"))
    judged = langid.predict(two, langid.fit(two, 100)).join(two.select("doc_id", "lang"), "doc_id")
    assert judged.where("lang = lang_pred").count() == 600


def test_toxicity(spark, docs):
    rng = random.Random(10)
    texts = [(k, words(rng, 30) + (" you vile idiot " if k % 3 == 0 else " you nice friend ") + words(rng, 20)) for k in range(600)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(600)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    scored = {r["doc_id"]: r for r in toxicity.score_documents(table, model).collect()}
    assert sum(scored[k]["predicted"] != (k % 3 == 0) for k in range(600) if zlib.crc32(str(k).encode()) % 3 == 1) <= 2
    hidden = spark.createDataFrame([(1, "you v1le 1d10t"), (2, "you n1ce fr13nd"), (3, "a v i l e one and an i d i o t")], "doc_id long, text string")
    assert [r["predicted"] for r in toxicity.score_documents(hidden, model).orderBy("doc_id").collect()] == [1, 0, 1]
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_documents(docs, model).collect())
