"""N-gram Jaccard join: documents link if their shingle sets are 0.8 alike; groups are the components of the links.

1. Every text gives its set of shingle codes, and equal sets are one class from then on.
2. Sets are put in one global order: codes that a sample shows to be very frequent come last, others by their value. Two
   sets that are alike enough share a code among the first fifth of each. Rows (code, class) of these prefixes meet by
   code; each code with two classes of near size names its smallest class as a hub for the others.
3. Texts of classes with a common hub meet in one block. Codes that one class of the block has alone are set aside, and
   classes that are left with too few codes fall away. The rest is stored in a prefix tree, frequent codes first. Each
   class walks the tree, sharing the overlap of common beginnings, and leaves a subtree when what is left of both cannot
   reach the overlap asked for, or when all of it is linked with it already. Overlaps are exact.
4. A block with many classes is cut into slices. All slices hold the hub, so classes like the hub are linked at once;
   only those that are not linked with it visit the other slices, two slices to a task.

No link between different sets is lost: the order only decides which codes are looked at first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import cut, in_tasks, row_key, shingle_codes, table, utf8, word_codes
from cellwright.llm.components import components

WIDTH = 5
#: The link asks for NEED * intersection >= PART * union.
NEED, PART = 100, 80
#: Documents in which frequent codes are looked for, the rows there that make a code frequent, and the codes kept. The
#: list only steers the order.
SAMPLE_ROWS, FREQUENT_ROWS, FREQUENT_CODES = 8000, 8, 100_000
#: Classes of one slice of a block.
SLICE_CLASSES = 1000
#: Up to so many sets of a block are held against one another without a tree, and rows of several blocks are sent together.
FEW_SETS, SENT_ROWS = 4, 10_000


def text_set(data: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle codes of UTF-8 text, rising."""
    return np.unique(shingle_codes(word_codes(data), width))


def class_key(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes(), seed=len(found)) - (1 << 63)


def spare(n):
    """How many codes of a set of ``n`` a set that is alike can be without."""
    return n - (PART * n + NEED - 1) // NEED


def asked(n):
    """How many codes two alike sets share among their first ``spare(n) + asked(n)``, for the smaller ``n`` of theirs.

    More than one, so that documents with only a passage in common are told from near copies by counting.
    """
    return np.maximum(1, (spare(n) + 1) // 2)


def prefix_length(n):
    """How many first codes of a set of ``n`` are looked at."""
    return spare(n) + asked(n)


def least_shared(n):
    """How many of the first codes of a set of ``n`` occur again if any set is alike, which may have 0.8 of its size."""
    return asked((PART * n + NEED - 1) // NEED)


def _signed(codes: np.ndarray) -> np.ndarray:
    return codes.view(np.int64)


class Node:
    """A node of the prefix tree: the codes on the edge to it, what hangs below, and bounds over it."""

    __slots__ = ("codes", "children", "rows", "longest", "smallest", "member", "uniform")

    def __init__(self, codes: np.ndarray):
        self.codes, self.children, self.rows = codes, {}, []
        self.longest, self.smallest = 0, 1 << 60  # codes left below the edge at most; smallest set below
        self.member, self.uniform = -1, True  # a row below; whether all rows below are one component


class Links:
    """Disjoint sets over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def survivors(sets: list[np.ndarray]) -> tuple[list[int], list[np.ndarray]]:
    """Rows that share enough codes with the others to be like any, and their shared codes as ranks, frequent first."""
    rows = [k for k, s in enumerate(sets) if len(s)]
    while rows:
        lengths = np.array([len(sets[k]) for k in rows])
        codes, place, counts = np.unique(np.concatenate([sets[k] for k in rows]), return_inverse=True, return_counts=True)
        shared = counts[place] > 1
        common = np.add.reduceat(shared, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        keep = NEED * common >= PART * lengths
        if keep.all():
            rank = np.empty(len(codes), np.int64)
            rank[np.lexsort((codes, -counts))] = np.arange(len(codes))
            ranked = np.split(rank[place], np.cumsum(lengths)[:-1])
            masks = np.split(shared, np.cumsum(lengths)[:-1])
            return rows, [np.sort(r[m]) for r, m in zip(ranked, masks)]
        rows = [k for k, good in zip(rows, keep.tolist()) if good]
    return [], []


class PrefixTree:
    """Sets of ranks, searched for those alike, over rows whose true sizes are ``sizes``."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], links: Links):
        self.sets, self.sizes, self.links = sets, sizes, links
        self.root = Node(np.zeros(0, np.int64))

    def _touch(self, node: Node, k: int, left: int) -> None:
        node.longest = max(node.longest, left)
        node.smallest = min(node.smallest, self.sizes[k])
        if node.member < 0:
            node.member = k
        elif node.uniform and self.links.find(node.member) != self.links.find(k):
            node.uniform = False

    def insert(self, k: int) -> None:
        codes = self.sets[k]
        node, at = self.root, 0
        self._touch(node, k, len(codes))
        while at < len(codes):
            child = node.children.get(int(codes[at]))
            if child is None:
                child = node.children[int(codes[at])] = Node(codes[at:])
                at = len(codes)
            else:
                edge = child.codes
                n = min(len(edge), len(codes) - at)
                differ = np.flatnonzero(edge[:n] != codes[at : at + n])
                same = int(differ[0]) if len(differ) else n
                if same < len(edge):  # the edge parts here
                    upper = Node(edge[:same])
                    upper.longest, upper.smallest = child.longest + len(edge) - same, child.smallest
                    upper.member, upper.uniform = child.member, child.uniform
                    child.codes = edge[same:]
                    upper.children[int(child.codes[0])] = child
                    node.children[int(codes[at])] = upper
                    child = upper
                at += same
            node = child
            self._touch(node, k, len(codes) - at)
        node.rows.append(k)

    def search(self, k: int, alike: list[tuple[int, int]], wanted=None) -> None:
        """Link row ``k`` with every stored row that is alike and not linked with it; add what was linked to ``alike``."""
        codes, size, find = self.sets[k], self.sizes[k], self.links.find
        stack = [(self.root, 0, 0)]  # node, codes of k passed, overlap so far
        while stack:
            node, passed, overlap = stack.pop()
            if node.uniform and node.member >= 0 and find(node.member) == find(k):
                continue
            if len(node.codes):
                spots = np.searchsorted(codes, node.codes)
                spots_in = spots < len(codes)
                overlap += int((codes[spots[spots_in]] == node.codes[spots_in]).sum())
                passed = int(np.searchsorted(codes, node.codes[-1], "right"))
            best = overlap + min(node.longest, len(codes) - passed)
            if (NEED + PART) * best < PART * (size + node.smallest):
                continue
            for r in node.rows:
                if (NEED + PART) * overlap >= PART * (size + self.sizes[r]) and find(r) != find(k) and (wanted is None or wanted(k, r)):
                    self.links.join(k, r)
                    alike.append((k, r))
            stack += [(c, passed, overlap) for c in node.children.values()]


def are_alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, both rising and with codes in them, are alike."""
    if NEED * min(len(a), len(b)) < PART * max(len(a), len(b)) or not len(a):
        return False
    both = np.concatenate((a, b))
    both.sort()
    return (NEED + PART) * int(np.count_nonzero(both[1:] == both[:-1])) >= PART * len(both)


def link_block(sets: list[np.ndarray], wanted=None) -> tuple[Links, list[tuple[int, int]]]:
    """All components of rows that are alike, and links that span them. ``wanted`` may leave out pairs known elsewhere."""
    links, alike = Links(len(sets)), []
    if len(sets) <= FEW_SETS:
        for a, b in combinations(range(len(sets)), 2):
            if links.find(a) != links.find(b) and (wanted is None or wanted(a, b)) and are_alike(sets[a], sets[b]):
                links.join(a, b)
                alike.append((a, b))
        return links, alike
    rows, ranked = survivors(sets)
    if len(rows) > 1:
        at = {k: n for n, k in enumerate(rows)}
        inner = Links(len(rows))
        pairs: list[tuple[int, int]] = []
        pick = None if wanted is None else lambda a, b: wanted(rows[a], rows[b])
        tree = PrefixTree(ranked, [len(sets[k]) for k in rows], inner)
        for k in sorted(rows, key=lambda k: (len(sets[k]), k)):
            tree.search(at[k], pairs, pick)
            tree.insert(at[k])
        for a, b in pairs:
            links.join(rows[a], rows[b])
            alike.append((rows[a], rows[b]))
    return links, alike


def frequent_codes(docs: DataFrame) -> np.ndarray:
    """Codes in many rows of a sample of about ``SAMPLE_ROWS`` documents, at most ``FREQUENT_CODES`` of them, rising."""
    count = docs.count()
    share = min(1_000_000, SAMPLE_ROWS * 1_000_000 // max(count, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for text in batch.column(0):
                found = text_set(utf8(text))
                if class_key(found) in seen:
                    continue  # copies in one task count once
                seen.add(class_key(found))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(found))], ["code"])

    sampled = docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < share).select("text")
    counted = in_tasks(sampled, run, "code long").groupBy("code").count().where(F.col("count") >= FREQUENT_ROWS)
    top = counted.orderBy(F.col("count").desc(), "code").limit(FREQUENT_CODES).select("code").collect()
    return np.sort(np.array([r["code"] for r in top], np.int64).view(np.uint64))


def prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(code, key, n): the first codes of the set of every class, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            firsts, keys, sizes = [], [], []
            for text in batch.column(0):
                found = text_set(utf8(text))
                key = class_key(found)
                if not len(found) or key in seen:
                    continue
                seen.add(key)
                last = np.zeros(len(found), bool)
                if len(frequent):
                    spot = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
                    last = frequent[spot] == found
                n = int(prefix_length(len(found)))
                firsts.append(np.concatenate([found[~last], found[last]])[:n])
                keys.append(np.full(n, key, np.int64))
                sizes.append(np.full(n, len(found), np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(np.concatenate(firsts))), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes))], ["code", "key", "n"]
                )

    return in_tasks(docs.select("text"), run, "code long, key long, n int")


def hubs(firsts: DataFrame) -> DataFrame:
    """(hub, key): classes that share a code and may be of one size, each with the smallest class there.

    Classes that share too few of their first codes to be like any other are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, 0  # the row before, and the hub of its group
        for batch in batches:
            if not batch.num_rows:
                continue
            c, k, n = (batch.column(j).to_numpy().astype(np.int64) for j in range(3))
            if last is not None:
                c, k, n = (np.concatenate([[a], b]) for a, b in zip(last, (c, k, n)))
            fresh = np.ones(len(c), bool)
            fresh[1:] = (c[1:] != c[:-1]) | (NEED * n[:-1] < PART * n[1:])  # another code, or a leap in size
            again = np.zeros(len(c), bool)  # the same class from another task
            again[1:] = ~fresh[1:] & (k[1:] == k[:-1])
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(c)), 0))
            head = k[start]
            if last is not None:
                head[start == 0] = hub
            rows = (k != head) & ~again
            if last is not None:
                rows[0] = False
            # The hub counts once in a group, with the first other class, which comes right after it.
            second = np.flatnonzero(rows[1:] & (k[:-1] == head[1:])) + 1
            pairs = np.concatenate(
                [np.column_stack([head[rows], k[rows], n[rows]]), np.column_stack([head[second], head[second], n[second - 1]])]
            )
            last, hub = (int(c[-1]), int(k[-1]), int(n[-1])), int(head[-1])
            if len(pairs):
                pairs, counts = np.unique(pairs, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2]), pa.array(counts)], ["hub", "key", "n", "shared"]
                )

    met = firsts.repartition("code").sortWithinPartitions("code", "n", "key")
    found = in_tasks(met, run, "hub long, key long, n long, shared long").groupBy("hub", "key", "n").agg(F.sum("shared").alias("shared"))
    return found


def likely_members(shared: DataFrame) -> DataFrame:
    """(hub, key) of classes that share enough of their first codes, in blocks of at least two such classes."""
    smaller = F.ceil(F.col("n") * PART / NEED)
    need = F.greatest(F.lit(1), F.floor((smaller - F.ceil(smaller * PART / NEED) + 1) / 2))
    enough = shared.groupBy("key", "n").agg(F.sum("shared").alias("total")).where(F.col("total") >= need).select("key")
    likely = shared.select("hub", "key").join(enough, "key")
    blocks = likely.groupBy("hub").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("hub")
    return cut(likely.join(blocks, "hub"), "members")


def _block_edges(blocks: DataFrame, read: Callable) -> DataFrame:
    """(block, key, root, with_hub): the component of every class in each group (block, slice, other) of (hub, key, home, loose, body).

    ``read`` makes a set of a body. Where ``slice`` and ``other`` differ, classes are only held against those of the
    other slice, and only if one of both is loose.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, hub, seen, keys, homes, loose, sets = None, None, set(), [], [], [], []
        out: tuple[list, ...] = ([], [], [], [])

        def settle() -> None:
            if len(keys) < 2:
                return
            apart = here[1] != here[2]
            links, _ = link_block(sets, (lambda a, b: homes[a] != homes[b] and (loose[a] or loose[b])) if apart else None)
            roots = [links.find(k) for k in range(len(keys))]
            hub_root = next((r for r, k in zip(roots, keys) if k == hub), -1)
            least: dict[int, int] = {}
            for r, k in zip(roots, keys):
                least[r] = min(k, least.get(r, k))
            for column, values in zip(out, ([here[0]] * len(keys), keys, [least[r] for r in roots], [r == hub_root for r in roots])):
                column.extend(values)

        def sent() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            done = pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(out, kinds)], ["block", "key", "root", "with_hub"])
            for column in out:
                column.clear()
            return done

        for batch in batches:
            at = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            heads, ids, own, free = (batch.column(k).to_pylist() for k in range(3, 7))
            for k, body in enumerate(batch.column(7)):
                if at[k] != here:
                    settle()
                    if len(out[0]) >= SENT_ROWS:
                        yield sent()
                    here, hub, seen, keys, homes, loose, sets = at[k], heads[k], set(), [], [], [], []
                if ids[k] in seen:  # rows equal in id and text that were not joined in one task
                    continue
                seen.add(ids[k])
                keys.append(ids[k])
                homes.append(own[k])
                loose.append(free[k])
                sets.append(read(body))
        settle()
        if out[0]:
            yield sent()

    met = blocks.select("block", "slice", "other", "hub", "key", "home", "loose", "body")
    met = met.repartition("block", "slice", "other").sortWithinPartitions("block", "slice", "other")
    return in_tasks(met, run, "block long, key long, root long, with_hub boolean")


def sliced_links(members: DataFrame, with_bodies: Callable, read: Callable, size: int) -> DataFrame:
    """(a, b): links that span the components of alike classes inside each block of ``members`` (block, hub, key).

    ``with_bodies`` adds the column ``body`` by ``key``, from which ``read`` makes a set. Every task holds two slices of
    about ``size`` classes at most, however large the block.
    """
    slices = members.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("slices"))
    members = members.join(slices, "block").withColumn("home", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int"))
    # The hub is at home in its own slice and a guest in all others.
    every = F.sequence(F.lit(0), F.col("slices") - 1)
    placed = members.select("block", "hub", "key", "home", F.explode(F.when(F.col("hub") == F.col("key"), every).otherwise(F.array("home"))).alias("slice"))
    placed = placed.select("block", "slice", F.col("slice").alias("other"), "hub", "key", "home", F.lit(False).alias("loose"))
    linked = cut(_block_edges(with_bodies(placed), read), "links")
    edges = linked.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b"))
    sliced = members.where("slices > 1")
    loose = cut(sliced.join(linked.where("NOT with_hub").select("block", "key"), ["block", "key"]), "loose")
    if not loose.head(1):
        return edges
    # Two slices meet, with all their classes, if both have a loose one; else the loose ones of one and all of the other.
    visitors = loose.select("block", "hub", "key", "home", F.lit(True).alias("loose"), F.explode(every).alias("to"))
    hosts = sliced.join(loose.select("block", "key"), ["block", "key"], "left_anti").join(loose.select("block", F.col("home").alias("to")).distinct(), "block")
    visits = visitors.unionByName(hosts.select("block", "hub", "key", "home", F.lit(False).alias("loose"), "to")).where("home <> to")
    visits = visits.select("block", F.least("home", "to").alias("slice"), F.greatest("home", "to").alias("other"), "hub", "key", "home", "loose")
    more = cut(_block_edges(with_bodies(visits), read), "links")
    return edges.unionByName(more.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")))


def _with_texts(docs: DataFrame, members: DataFrame, reps: DataFrame) -> DataFrame:
    """``members`` (block, slice, other, hub, key, home, loose) with the text of one document of each class as ``body``."""
    names = ["block", "slice", "other", "hub", "key", "home", "loose"]
    wanted = members.join(reps.select("key", "id", "row"), "key").groupBy("id", "row").agg(F.collect_list(F.struct(*names)).alias("places"))
    wanted = wanted.select(F.col("id").alias("wanted_id"), F.col("row").alias("wanted_row"), "places")
    found = docs.join(wanted, (F.col("row") == F.col("wanted_row")) & F.col("id").eqNullSafe(F.col("wanted_id")))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            at = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            fresh = [k for k, place in enumerate(at) if place not in seen and not seen.add(place)]
            if len(seen) > 1_000_000:
                seen.clear()
            yield batch.take(pa.array(fresh, pa.int64())).select(["text", "places"])

    # Rows equal in id and text are one document: they meet in one task, and one goes on to the blocks.
    found = found.select("id", "row", "text", "places")
    schema = f"text string, places {found.schema['places'].dataType.simpleString()}"
    return in_tasks(found, once, schema).select(F.col("text").alias("body"), F.inline("places"))


def _read_text(value: pa.Scalar) -> np.ndarray:
    return text_set(utf8(value))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, n_shingles, component_id, keeper) for every row of ``docs``.

    ``row`` is a key of id and text; rows equal in both are one document. ``component_id`` is the smallest id reachable
    by links, ids of NULL apart; ``keeper`` marks the first document of each group by id, then by ``row``. Texts that are
    NULL or have no words have no shingles, link with nothing and keep their own id. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_set(utf8(t)) for t in batch.column(2)]
            keys = pa.array([class_key(f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, pa.array([len(f) for f in found], pa.int64())], ["id", "row", "key", "n"])

    light = cut(in_tasks(rows, classify, "id long, row long, key long, n long"), "classes")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    reps = cut(light.where("n > 0").groupBy("key").agg(first.alias("rep")).select("key", "rep.id", "rep.row"), "reps")
    members = likely_members(cut(hubs(prefixes(rows, frequent_codes(rows))), "hubs"))
    members = members.select(F.col("hub").alias("block"), "hub", "key")
    edges = sliced_links(members, lambda placed: _with_texts(rows, placed, reps), _read_text, SLICE_CLASSES)
    named = components(edges)
    # The first document of each class, then of each component.
    classes = reps.join(named, F.col("key") == F.col("node"), "left").select("key", F.coalesce("component", "key").alias("component"), "id", "row")
    heads = classes.groupBy("component").agg(first.alias("head"))
    heads = classes.select("key", "component").join(heads, "component").select("key", "head.id", "head.row")
    heads = heads.select(F.col("key").alias("of"), F.col("id").alias("head_id"), F.col("row").alias("head_row"))
    alone = F.col("n") == 0
    return light.join(heads, F.col("key") == F.col("of"), "left").select(
        "id",
        "row",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.col("head_id")).alias("component_id"),
        (alone | ((F.col("row") == F.col("head_row")) & F.col("id").eqNullSafe(F.col("head_id")))).alias("keeper"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest id. Columns stay as they are.

    Documents without words stay. Rows equal in id and text stay or go together.
    """
    names = docs.columns
    gone = near_groups(docs).where("NOT keeper").select(F.col("id").alias("gone_id"), F.col("row").alias("gone_row")).distinct()
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("id"), row_key(docs["doc_id"], docs["text"]).alias("key"))
    kept = rows.join(gone, (F.col("key") == F.col("gone_row")) & F.col("id").eqNullSafe(F.col("gone_id")), "left_anti")
    return kept.select(*(F.col("row").getField(n).alias(n) for n in names))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


QUERIES = {"op7_jaccard": op7_jaccard}
ORACLE: dict[str, str] = {}
