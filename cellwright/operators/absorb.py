"""Factors with many levels, taken out of the rows of a regression.

The rows are summed to cells, one per combination of levels; only counts and sums of the columns are shuffled, never their
products. One factor's effects are the means of its cells. With several, the factor with the most levels is eliminated, and
the effects of the others' levels solve the remaining normal equations by conjugate gradients, scaled by the levels' counts.

The cells of each level of the eliminated factor are packed into one written row, which a single shuffle brings together. A
round reads these rows as they lie, takes the means of the eliminated levels row by row, and shuffles only sums for the other
levels, as many as its tasks meet. Rows that hardly ever share a cell are packed themselves, and no cells are made of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from cellwright.operators.joins import SALTS, hot_keys, lookup_join
from cellwright.session import cut, in_tasks

#: Rounds end when no column's remainder is longer than this share of what it was at first.
TOLERANCE = 1e-11
#: What is shorter than this share of the columns' own length, which is 1 for each row, is rounding: there is nothing to take out.
ROUNDING = 1e-13
#: Up to so many cells the equations are solved on the driver, by the same rounds.
SMALL_CELLS = 50_000
#: Up to about so many numbers (levels of all factors but the main one, times columns) the levels' vectors lie on the driver and are
#: sent to the tasks in every round. Beyond, they stay tables, and every round joins the cells to them.
LEVEL_NUMBERS = 4_000_000
#: A level of the main factor with more cells than about this is not eliminated but solved for among the others.
HOT_CELLS = 100_000
#: A task works on packed rows of about so many cells at a time.
PIECE_CELLS = 500_000


@dataclass
class Swept:
    """Rows without the factors' effects, and what was found on the way. Without ``cells``, each row is one. ``levels`` has the
    levels of those factors for which they are known already."""

    rows: DataFrame
    cells: DataFrame | None
    rounds: int
    levels: dict[str, DataFrame] = field(default_factory=dict)


def factor_cells(rows: DataFrame, keys: Sequence[str], z: Sequence[str]) -> DataFrame:
    """Count and sums of the columns for every combination of the keys."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(a).alias(f"s_{a}") for a in z])


def sweep_rows(
    rows: DataFrame,
    segment: Sequence[str],
    factors: Sequence[str],
    z: Sequence[str],
    most_rounds: int = 500,
    small_cells: int = SMALL_CELLS,
) -> Swept:
    """Take the factors' effects out of the columns ``z``, within segments. Other columns of the rows stay.

    Keys must not be NULL; the columns are centred and of unit spread. With several factors, not settling after ``most_rounds`` rounds is an error.
    """
    keys = list(dict.fromkeys([*segment, *factors]))
    if len(factors) > 1:
        main, few, found = _shape(rows, segment, factors, keys, z)
        if few and found["cells"] > max(small_cells, found["n"] / 2):
            packed, rounds, levels = _packed_effects(rows, None, found["n"], segment, factors, main, z, most_rounds)
            return Swept(_without_effects(packed, z), None, rounds, levels)
    cells = cut(factor_cells(rows, keys, z), "cells")
    rounds, levels = 1, {}
    if len(factors) == 1:
        effects = cells.select(*keys, *[(F.col(f"s_{a}") / F.col("n")).alias(f"t_{a}") for a in z])
    elif cells.limit(small_cells + 1).count() <= small_cells:
        effects, rounds = _small_effects(cells, segment, factors, keys, z, most_rounds)
    elif few:
        packed, rounds, levels = _packed_effects(cells, "n", found["n"], segment, factors, main, z, most_rounds)
        effects = cut(packed.select(*keys, *[f"t_{a}" for a in z]), "effects")
    else:
        effects, rounds = level_effects(cells, segment, factors, main, z, most_rounds)
    return Swept(_without_effects(lookup_join(rows, effects, keys, null_safe=False), z), cells, rounds, levels)


def _without_effects(rows: DataFrame, z: Sequence[str]) -> DataFrame:
    return rows.withColumns({a: F.col(a) - F.col(f"t_{a}") for a in z}).drop(*[f"t_{a}" for a in z])


def _level(segment: Sequence[str], factor: str) -> list[str]:
    return list(dict.fromkeys([*segment, factor]))


def _shape(rows: DataFrame, segment: Sequence[str], factors: Sequence[str], keys: Sequence[str], z: Sequence[str]):
    """The place of the factor with the most levels, whether the others have few, and about how many rows and cells there are."""
    sizes = [F.approx_count_distinct(F.xxhash64(*_level(segment, f))).alias(f"i{k}") for k, f in enumerate(factors)]
    found = rows.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(*keys)).alias("cells"), *sizes).first()
    main = max(range(len(factors)), key=lambda k: found[f"i{k}"])
    few = sum(found[f"i{k}"] for k in range(len(factors)) if k != main) * len(z) <= LEVEL_NUMBERS
    return main, few, found


def _conjugate(
    r: np.ndarray, size: np.ndarray, n: float, product: Callable[[np.ndarray], np.ndarray], most_rounds: int, factors: Sequence[str]
) -> tuple[np.ndarray, int]:
    """Conjugate gradients, scaled by ``size``, for each column of ``r`` at once, and the number of rounds."""
    x, p = np.zeros_like(r), r / size
    first = left = (r * r / size).sum(0)
    enough = np.maximum(TOLERANCE**2 * first, ROUNDING**2 * n)
    for rounds in range(most_rounds + 1):
        open_ = left > enough
        if not open_.any():
            return x, rounds
        q = product(p)
        curve = (p * q).sum(0)
        alpha = np.divide(left, curve, out=np.zeros(len(left)), where=open_ & (curve > 0))
        x, r = x + alpha * p, r - alpha * q
        now = (r * r / size).sum(0)
        beta = np.divide(now, left, out=np.zeros(len(left)), where=open_ & (left > 0))
        left = np.where(open_, now, left)
        p = r / size + beta * p
    raise RuntimeError(f"the factors {list(factors)} did not settle in {most_rounds} rounds")


class _Packed:
    """The cells of a batch of packed rows, one after the other. ``ids`` are their levels; ``hot`` is ``none`` where the main level is eliminated."""

    def __init__(self, batch: pa.RecordBatch, ids: Sequence[str], sums: Sequence[str], none: int):
        def flat(name: str) -> np.ndarray:
            return batch.column(name).flatten().to_numpy(zero_copy_only=False)

        lengths = pc.list_value_length(batch.column("n")).to_numpy(zero_copy_only=False)
        self.start = np.cumsum(lengths) - lengths
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        self.n = flat("n")
        self.sums = np.column_stack([flat(a) for a in sums]) if sums else None
        hot = pc.fill_null(batch.column("hot"), none).to_numpy(zero_copy_only=False)
        self.eliminated = hot == none
        self.ids = [*[flat(i) for i in ids], hot[self.row]]

    def at(self, vector: np.ndarray) -> np.ndarray:
        return reduce(lambda a, b: a + b, [vector[i] for i in self.ids])

    def means(self, values: np.ndarray) -> np.ndarray:
        """The mean of each cell's eliminated level, 0 where it has none."""
        found = np.add.reduceat(values, self.start) / np.add.reduceat(self.n, self.start)[:, None]
        return np.where(self.eliminated[:, None], found, 0.0)[self.row]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed rows of all batches, few at a time where they are long."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("n")).to_numpy(zero_copy_only=False))
        first = np.flatnonzero(np.diff(ends // PIECE_CELLS, prepend=-1))
        for begin, end in zip(first, [*first[1:], batch.num_rows]):
            yield batch.slice(begin, end - begin)


def _sum_batches(ids: Sequence[str], sums: Sequence[str], vector, columns: int, none: int):
    """Values of cells less the means of the eliminated levels, summed by the other levels: of ``sums``, with the counts, or of a vector sent."""
    names = [f"v{j}" for j in range(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((none + 1, columns)), np.zeros(none + 1, bool)
        for batch in _pieces(batches):
            cells = _Packed(batch, ids, sums, none)
            values = cells.sums if sums else cells.n[:, None] * cells.at(vector.value)
            values = values - cells.n[:, None] * cells.means(values)
            values = np.column_stack([values, cells.n]) if sums else values
            for i in cells.ids:
                seen[i] = True
                for j in range(columns):
                    total[:, j] += np.bincount(i, values[:, j], none + 1)
        seen[none] = False
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *[pa.array(total[found, j]) for j in range(columns)]], ["id", *names])

    return run, ", ".join(["id bigint", *[f"{v} double" for v in names]])


def _effect_batches(main: Sequence[str], ids: Sequence[str], others: Sequence[str], sums: Sequence[str], vector, none: int, columns: Sequence[str]):
    """Every cell by itself again, with the sum of all factors' effects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            cells = _Packed(batch, ids, sums, none)
            effects = cells.at(vector.value)
            effects = effects + cells.means(cells.sums - cells.n[:, None] * effects)
            row = pa.array(cells.row)
            arrays = [*[batch.column(m).take(row) for m in main], *[batch.column(c).flatten() for c in (*ids, *others, *sums)]]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(np.ascontiguousarray(t)) for t in effects.T]], columns)

    return run


def _packed_effects(
    units: DataFrame, count: str | None, n: int, segment: Sequence[str], factors: Sequence[str], main: int, z: Sequence[str], most_rounds: int
) -> tuple[DataFrame, int, dict[str, DataFrame]]:
    """The units, which are cells with a ``count`` or rows without, with the sum of all factors' effects ``t_<z>``; the rounds it
    took, and the levels of every factor. The gradients' vectors lie on the driver."""
    spark = units.sparkSession
    short = {c: f"c{i}" for i, c in enumerate(units.columns)}
    coded = units.select(*[F.col(f"`{c}`").alias(a) for c, a in short.items()])
    of_main = _level(segment, factors[main])
    levels, size = {}, 0

    def numbered(table: DataFrame, number: str, how: str) -> DataFrame:
        """Number a few levels, going on from those before, and bring the numbers to the units."""
        nonlocal coded, size
        columns = table.columns
        known = cut(table.distinct().coalesce(1).withColumn("_id", (F.monotonically_increasing_id() + size).cast("int")), "numbers")
        size += known.count()
        named = known.select(*[F.col(f"`{c}`").alias(f"_{short[c]}") for c in columns], F.col("_id").alias(number))
        test = reduce(lambda a, b: a & b, [F.col(short[c]) == F.col(f"_{short[c]}") for c in columns])
        coded = coded.join(F.broadcast(named), test, how).drop(*[f"_{short[c]}" for c in columns])
        return known

    ids = {f"i{k}": f for k, f in enumerate(f for k, f in enumerate(factors) if k != main)}
    for i, f in ids.items():
        levels[f] = numbered(units.select(*_level(segment, f)), i, "inner")
    keys = [short[c] for c in of_main]
    by = keys
    hot = hot_keys(units, of_main, HOT_CELLS)
    if hot is not None:
        numbered(hot, "hot", "left")
        salt = F.pmod(F.xxhash64(*[c for c in coded.columns if "map<" not in coded.schema[c].dataType.simpleString()], F.spark_partition_id()), F.lit(SALTS))
        coded = coded.withColumn("part", F.when(F.col("hot").isNotNull(), salt).otherwise(F.lit(0)))
        by = [*keys, "hot", "part"]
    sums = [short[f"s_{a}" if count else a] for a in z]
    # The other factors' keys stay behind, and come back by their numbers.
    others = [a for c, a in short.items() if a not in {*keys, *sums} and c not in {*ids.values(), count}]
    weight = F.col(short[count]).cast("double") if count else F.lit(1.0)
    cell = F.struct(weight.alias("n"), *ids, *others, *sums).alias("cell")
    packed = coded.select(*by, cell).repartition(*[c for c in by if c != "hot"]).groupBy(*by).agg(F.collect_list("cell").alias("cells"))
    packed = cut(packed if hot is not None else packed.withColumn("hot", F.lit(None).cast("int")), "packed")
    levels[factors[main]] = packed.select(*[F.col(short[c]).alias(c) for c in of_main]).distinct()

    def lists(columns: Sequence[str]) -> list[Column]:
        return [F.col(f"cells.{c}").alias(c) for c in columns]

    def sent(vector: np.ndarray):
        return spark.sparkContext.broadcast(np.vstack([vector, np.zeros(len(z))]))

    def summed(columns: Sequence[str], vector=None) -> np.ndarray:
        run, schema = _sum_batches(list(ids), columns, vector, len(z) + bool(columns), size)
        # The fewer tasks, the fewer sums of one level.
        read = packed.select("hot", *lists(["n", *ids, *columns])).coalesce(spark.sparkContext.defaultParallelism)
        parts = in_tasks(read, run, schema)
        found = parts.groupBy("id").agg(*[F.sum(v).alias(v) for v in parts.columns[1:]]).toArrow()
        out = np.zeros((size, len(z) + bool(columns)))
        out[found.column("id").to_numpy()] = np.column_stack([c.to_numpy() for c in found.columns[1:]])
        return out

    def product(p: np.ndarray) -> np.ndarray:
        vector = sent(p)
        found = summed([], vector)
        vector.destroy()
        return found

    first = summed(sums)
    x, rounds = _conjugate(first[:, :-1], first[:, -1:], n, product, most_rounds, factors)
    columns = [*keys, *ids, *others, *sums]
    flat = StructType([coded.schema[c] for c in columns])
    for a in z:
        flat = flat.add(f"t_{a}", DoubleType())
    whole = packed.select("hot", *keys, *lists(["n", *ids, *others, *sums]))
    found = in_tasks(whole, _effect_batches(keys, list(ids), others, sums, sent(x), size, flat.names), flat)
    for i, f in ids.items():
        if f not in of_main:
            found = found.join(F.broadcast(levels[f].select(F.col(f"`{f}`").alias(short[f]), F.col("_id").alias(i))), i)
    kept = [F.col(a).alias(c) for c, a in short.items() if c != count]
    return found.select(*kept, *[f"t_{a}" for a in z]), rounds, levels


def level_effects(
    cells: DataFrame, segment: Sequence[str], factors: Sequence[str], main: int, z: Sequence[str], most_rounds: int
) -> tuple[DataFrame, int]:
    """The sum of all factors' effects ``t_<z>`` for every cell, and the number of rounds it took. Nothing of a level reaches the driver."""
    keys = list(dict.fromkeys([*segment, *factors]))
    coded = _coded(cells, segment, factors)
    rest = [f"i{k}" for k in range(len(factors)) if k != main]
    narrow = coded.select(F.col(f"i{main}").alias("m"), *rest, "n")
    whole = cut(
        coded.groupBy(F.col(f"i{main}").alias("m")).agg(F.sum("n").alias("_n"), *[F.sum(f"s_{a}").alias(f"_s_{a}") for a in z]), "main"
    )
    means = whole.select("m", *[(F.col(f"_s_{a}") / F.col("_n")).alias(f"_m_{a}") for a in z])

    def to_levels(df: DataFrame, values: dict[str, object], names: Sequence[str]) -> DataFrame:
        """Sum values of cells by the levels of all factors but the main one, in one shuffle."""
        spread = df.withColumns(values).select(F.explode(F.array(*rest)).alias("id"), "n", *names)
        return spread.groupBy("id").agg(F.sum("n").alias("size"), *[F.sum(c).alias(c) for c in names])

    def of_levels(state: DataFrame, column: str) -> DataFrame:
        """Cells with ``u_<z>``, the sum of a column over the cell's levels."""
        found = narrow
        for i in rest:
            part = state.select(F.col("id").alias(i), *[F.col(f"{column}_{a}").alias(f"_{i}_{a}") for a in z])
            found = lookup_join(found, part, [i], null_safe=False, hot=None)
        added = {f"u_{a}": reduce(lambda x, y: x + y, [F.col(f"_{i}_{a}") for i in rest]) for a in z}
        return found.withColumns(added).select("m", *rest, "n", *added)

    start = lookup_join(coded.select(F.col(f"i{main}").alias("m"), *rest, "n", *[f"s_{a}" for a in z]), means, ["m"], null_safe=False, hot=None)
    state = to_levels(start, {f"r_{a}": F.col(f"s_{a}") - F.col("n") * F.col(f"_m_{a}") for a in z}, [f"r_{a}" for a in z])
    state = state.withColumns({**{f"x_{a}": F.lit(0.0) for a in z}, **{f"p_{a}": F.col(f"r_{a}") / F.col("size") for a in z}})
    state = cut(state, "levels")

    def lengths(df: DataFrame) -> np.ndarray:
        row = df.agg(*[F.sum(F.col(f"r_{a}") * F.col(f"r_{a}") / F.col("size")).alias(a) for a in z]).first()
        return np.array([float(row[a] or 0.0) for a in z])

    first = left = lengths(state)
    enough = np.maximum(TOLERANCE**2 * first, ROUNDING**2 * float(whole.agg(F.sum("_n")).first()[0]))
    for rounds in range(most_rounds + 1):
        open_ = left > enough
        if not open_.any():
            break
        moved = of_levels(state, "p")
        average = moved.groupBy("m").agg(*[(F.sum(F.col("n") * F.col(f"u_{a}")) / F.sum("n")).alias(f"_a_{a}") for a in z])
        moved = moved.join(average, "m")
        pushed = to_levels(moved, {f"q_{a}": F.col("n") * (F.col(f"u_{a}") - F.col(f"_a_{a}")) for a in z}, [f"q_{a}" for a in z])
        seen = Observation("steps")
        step = state.join(pushed.drop("size"), "id").observe(seen, *[F.sum(F.col(f"p_{a}") * F.col(f"q_{a}")).alias(a) for a in z])
        step = cut(step, "levels")
        curve = np.array([float(seen.get[a] or 0.0) for a in z])
        alpha = np.divide(left, curve, out=np.zeros(len(z)), where=open_ & (curve > 0))
        rest_of = {a: F.col(f"r_{a}") - F.lit(float(w)) * F.col(f"q_{a}") for a, w in zip(z, alpha)}
        # The lengths are summed anew: following them from the step loses too many digits.
        now = lengths(step.select("size", *[r.alias(f"r_{a}") for a, r in rest_of.items()]))
        beta = np.divide(now, left, out=np.zeros(len(z)), where=open_ & (left > 0))
        left = np.where(open_, now, left)
        state = step.select(
            "id",
            "size",
            *[r.alias(f"r_{a}") for a, r in rest_of.items()],
            *[(F.col(f"x_{a}") + F.lit(float(w)) * F.col(f"p_{a}")).alias(f"x_{a}") for a, w in zip(z, alpha)],
            *[(rest_of[a] / F.col("size") + F.lit(float(w)) * F.col(f"p_{a}")).alias(f"p_{a}") for a, w in zip(z, beta)],
        )
    else:
        raise RuntimeError(f"the factors {list(factors)} did not settle in {most_rounds} rounds")

    found = of_levels(cut(state.select("id", *[f"x_{a}" for a in z]), "effects"), "x")
    taken = found.groupBy("m").agg(*[F.sum(F.col("n") * F.col(f"u_{a}")).alias(f"_a_{a}") for a in z])
    own = whole.join(taken, "m").select("m", *[((F.col(f"_s_{a}") - F.col(f"_a_{a}")) / F.col("_n")).alias(f"_t_{a}") for a in z])
    found = lookup_join(found, cut(own, "main"), ["m"], null_safe=False, hot=None)
    total = found.select(F.col("m").alias(f"i{main}"), *rest, *[(F.col(f"u_{a}") + F.col(f"_t_{a}")).alias(f"t_{a}") for a in z])
    ids = [f"i{k}" for k in range(len(factors))]
    named = lookup_join(coded.select(*keys, *ids), cut(total, "effects"), ids, null_safe=False, hot=None)
    return cut(named.drop(*ids), "effects"), rounds


def _coded(cells: DataFrame, segment: Sequence[str], factors: Sequence[str]) -> DataFrame:
    """The cells with a number ``i<k>`` for the level of every factor; numbers of different factors differ."""
    coded = cells
    for k, factor in enumerate(factors):
        level = list(dict.fromkeys([*segment, factor]))
        numbered = cells.select(*level).distinct().withColumn(f"i{k}", F.monotonically_increasing_id() * len(factors) + k)
        coded = lookup_join(coded, cut(numbered, "numbers"), level, null_safe=False, hot=None)
    return cut(coded, "coded")


def _small_effects(
    cells: DataFrame, segment: Sequence[str], factors: Sequence[str], keys: Sequence[str], z: Sequence[str], most_rounds: int
) -> tuple[DataFrame, int]:
    """The same rounds in memory, for at most ``SMALL_CELLS`` cells."""
    rows = cells.collect()
    n = np.array([row["n"] for row in rows], float)
    sums = np.array([[float(row[f"s_{a}"]) for a in z] for row in rows]).reshape(len(rows), len(z))
    codes = []
    for factor in factors:
        numbers: dict[tuple, int] = {}
        codes.append(np.array([numbers.setdefault(tuple(row[c] for c in (*segment, factor)), len(numbers)) for row in rows]))
    main = codes.pop(max(range(len(factors)), key=lambda k: codes[k].max()))
    start = np.cumsum([0, *[c.max() + 1 for c in codes]])
    rest = [c + s for c, s in zip(codes, start)]
    size = sum(np.bincount(c, n, start[-1]) for c in rest)[:, None]
    main_size = np.bincount(main, n)[:, None]

    def by(code: np.ndarray, values: np.ndarray, length: int) -> np.ndarray:
        return np.column_stack([np.bincount(code, column, length) for column in values.T])

    def within(values: np.ndarray) -> np.ndarray:
        """Weighted values of cells less the mean of the main factor's level, summed by the other levels."""
        left = values - n[:, None] * (by(main, values, len(main_size)) / main_size)[main]
        return sum(by(c, left, start[-1]) for c in rest)

    x, rounds = _conjugate(within(sums), size, n.sum(), lambda p: within(n[:, None] * sum(p[c] for c in rest)), most_rounds, factors)
    effects = sum(x[c] for c in rest)
    effects = effects + (by(main, sums - n[:, None] * effects, len(main_size)) / main_size)[main]
    types = ", ".join([*[f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys], *[f"t_{a} double" for a in z]])
    table = [(*[row[k] for k in keys], *map(float, t)) for row, t in zip(rows, effects)]
    return cut(cells.sparkSession.createDataFrame(table, types), "effects"), rounds


def connected_parts(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Vertices ``v`` of a graph with the smallest vertex ``part`` that is connected to them.

    Every round, each vertex hooks on to its smallest neighbour, chains of hooks are followed to their ends by doubling, and
    the graph shrinks to the ends. Vertices are numbers.
    """
    both = edges.select(F.col(a).alias("v"), F.col(b).alias("w")).unionByName(edges.select(F.col(b).alias("v"), F.col(a).alias("w")))
    both = cut(both.distinct(), "edges")
    labels = cut(both.select("v").distinct().withColumn("part", F.col("v")), "parts")
    while not both.where("v != w").isEmpty():
        hooks = cut(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("up")), "hooks")
        while True:
            ends = hooks.select(F.col("v").alias("up"), F.col("up").alias("upper"))
            changed = Observation("changed")
            jumped = hooks.join(ends, "up").select("v", F.col("upper").alias("up"), (F.col("upper") != F.col("up")).alias("moved"))
            hooks = cut(jumped.observe(changed, F.count_if("moved").alias("n")), "hooks").drop("moved")
            if not changed.get["n"]:
                break
        ends = hooks.select(F.col("v").alias("part"), F.col("up"))
        labels = cut(labels.join(ends, "part", "left").select("v", F.coalesce("up", "part").alias("part")), "parts")
        shrunk = both.join(hooks, "v").select(F.col("up").alias("v"), "w")
        shrunk = shrunk.join(hooks.select(F.col("v").alias("w"), F.col("up").alias("to")), "w").select("v", F.col("to").alias("w"))
        both = cut(shrunk.where("v != w").distinct(), "edges")
    return labels


def dependent_levels(cells: DataFrame, segment: Sequence[str], factors: Sequence[str]) -> DataFrame:
    """How many level columns the others already span, by segment: ``dependent``.

    Of two factors, as many as their levels fall into connected parts, which is exact. A further factor counts the most
    parts it makes with any factor before it, which is a lower bound.
    """
    coded = _coded(cells, segment, factors)
    by_factor = []
    for k in range(1, len(factors)):
        counts = []
        for j in range(k):
            parts = connected_parts(coded, f"i{j}", f"i{k}").select(F.col("v").alias(f"i{j}"), "part")
            of_segment = coded.select(*segment, f"i{j}").distinct().join(parts, f"i{j}")
            counts.append(of_segment.groupBy(*segment).agg(F.count_distinct("part").alias("n")))
        most = reduce(lambda x, y: x.unionByName(y), counts).groupBy(*segment).agg(F.max("n").alias("n"))
        by_factor.append(most)
    return cut(reduce(lambda x, y: x.unionByName(y), by_factor).groupBy(*segment).agg(F.sum("n").alias("dependent")), "dependent")
