"""Equi-joins whose keys may be NULL, skewed, or of unknown size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.numeric import ratio
from cellwright.session import cut

# Below the session's own broadcast threshold the planner sends a lookup to every executor by itself. A
# lookup of unknown size, such as rows given by the user, is sent once it was counted within both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
# A key with more rows than this is spread over SALTS tasks. There are at most rows / HOT_ROWS such keys.
HOT_ROWS = 5_000_000
SAMPLE_HITS = 2_000
SALTS = 256


def key_match(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], null_safe: bool = True) -> Column:
    """Equality on every key pair; with ``null_safe`` a missing key matches a missing key."""
    tests = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in pairs]
    return reduce(lambda x, y: x & y, tests)


def generates(df: DataFrame) -> bool:
    """Whether the plan of a table holds a generator, which the planner's size estimate leaves out."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(line.lstrip(" :+-").startswith("Generate ") for line in plan.splitlines())


def planned_small(lookup: DataFrame) -> bool:
    """Whether the planner's size estimate of a table lies under the session's broadcast threshold.

    The estimate rests on file sizes. It does not grow through a generator such as ``explode``, so a table
    that has one in its plan never counts as small.
    """
    if generates(lookup):
        return False
    plan = lookup._jdf.queryExecution().optimizedPlan()
    threshold = lookup.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(plan.stats().sizeInBytes())) <= int(threshold)


def within_broadcast(lookup: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Count the rows and bytes of a table, in one aggregate over all of it."""
    width = reduce(
        lambda x, y: x + y,
        [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + F.lit(8) for c in lookup.columns],
    )
    seen = lookup.agg(F.count("*").alias("n"), F.sum(width.cast("bigint")).alias("size")).first()
    return seen["n"] <= rows and (seen["size"] or 0) <= size


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> DataFrame | None:
    """The keys that about ``hot_rows`` rows or more share, as a written table, or None where there are none.

    Only the key columns are read, and a sample of them is counted that holds some thousand rows of any
    such key. The sample decides how rows are spread over tasks, never which rows are joined.
    """
    hot_rows = hot_rows or HOT_ROWS
    fraction = min(1.0, SAMPLE_HITS / hot_rows)
    seen = df.select(*keys) if fraction == 1.0 else df.select(*keys).sample(fraction=fraction, seed=1)
    counted = seen.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows * fraction)
    found = cut(counted.select(*keys), "hot-keys")
    return None if found.isEmpty() else found


def chain_hot_keys(df: DataFrame, key_sets: Sequence[Sequence[str]], hot_rows: int | None = None) -> list[DataFrame | None]:
    """The same for several sets of keys, from one scan and one sample: a table, or None, for each set."""
    sets = list(dict.fromkeys(tuple(sorted(keys)) for keys in key_sets))
    columns = sorted({k for keys in sets for k in keys})
    hot_rows = hot_rows or HOT_ROWS
    fraction = min(1.0, SAMPLE_HITS / hot_rows)
    seen = df.select(*columns) if fraction == 1.0 else df.select(*columns).sample(fraction=fraction, seed=1)
    grouped = seen.groupingSets([[F.col(k) for k in keys] for keys in sets], *[F.col(k) for k in columns])
    counted = grouped.agg(F.grouping_id().alias("_set"), F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows * fraction)
    found = cut(counted.drop("_rows"), "hot-keys")
    numbers = {keys: sum(1 << (len(columns) - 1 - i) for i, k in enumerate(columns) if k not in keys) for keys in sets}
    present = {row["_set"] for row in found.select("_set").distinct().collect()}
    tables = {keys: found.where(F.col("_set") == n).select(*keys) if n in present else None for keys, n in numbers.items()}
    return [tables[tuple(sorted(keys))] for keys in key_sets]


@dataclass(frozen=True)
class Lookup:
    """One join of a chain, as ``lookup_join`` takes it."""

    table: DataFrame
    on: Sequence[str] | Mapping[str, str]
    how: str = "left"
    null_safe: bool = True
    measure: bool = False

    @property
    def keys(self) -> list[str]:
        return list(self.on)


def lookup_chain(df: DataFrame, lookups: Sequence[Lookup], hot_rows: int | None = None) -> DataFrame:
    """Join a large table to several lookups, one after the other.

    The heavy keys of all joins whose lookup is not small are looked for in one scan of the large table, instead of one run of
    the plan so far for each. A join by a column that an earlier lookup brings looks for its heavy keys by itself.
    """
    ways = ["planned" if planned_small(one.table) else "sent" if one.measure and within_broadcast(one.table) else "shuffled" for one in lookups]
    spread = [i for i, one in enumerate(lookups) if ways[i] == "shuffled" and set(one.keys) <= set(df.columns)]
    often = dict(zip(spread, chain_hot_keys(df, [lookups[i].keys for i in spread], hot_rows))) if spread else {}
    for i, one in enumerate(lookups):
        if ways[i] == "shuffled":
            df = lookup_join(df, one.table, one.on, one.how, one.null_safe, None if i in often else "sample", hot_rows=hot_rows, use_estimate=False, often=often.get(i))
        else:
            lookup = one.table if ways[i] == "planned" else F.broadcast(one.table)
            df = lookup_join(df, lookup, one.on, one.how, one.null_safe, None)
    return df


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    on: Sequence[str] | Mapping[str, str],
    how: str = "left",
    null_safe: bool = True,
    hot: str | None = "sample",
    sample_from: DataFrame | None = None,
    measure: bool = False,
    hot_rows: int | None = None,
    use_estimate: bool = True,
    suffixes: tuple[str, str] | None = None,
    often: DataFrame | None = None,
) -> DataFrame:
    """Join a large table to a lookup and drop the lookup's key columns. ``how`` is 'left' or 'inner'.

    Other columns that both have get the ``suffixes``; without these they are an error.

    A lookup that the planner knows to be small is broadcast. With ``measure`` one of unknown size is counted
    first. A larger one is shuffled, and keys that too many rows of the large table share are first
    spread over ``SALTS`` tasks, with the lookup's rows of just those keys repeated once per salt.

    ``hot`` is 'sample' to look for such keys, or None where the keys are unique in the large table. They are
    looked for in ``sample_from``, by default the large table itself; where that is the outcome of other
    joins, name the table before them. An aggregate that is small should come as a written table
    (``session.cut``), as then its true size is known and it is computed once. ``often`` is a table of heavy keys that
    is known already.
    """
    if how not in ("left", "inner"):
        raise ValueError("lookup_join takes 'left' or 'inner'")
    pairs = list(on.items()) if isinstance(on, Mapping) else [(k, k) for k in on]
    shared = [c for c in lookup.columns if c in df.columns and c not in [b for _, b in pairs]]
    if shared:
        if suffixes is None or set(shared) & {a for a, _ in pairs}:
            raise ValueError(f"both tables have {shared}; give suffixes or rename")
        df = df.withColumnsRenamed({c: c + suffixes[0] for c in shared})
        lookup = lookup.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    lookup = lookup.withColumnsRenamed({b: f"_k{i}" for i, (_, b) in enumerate(pairs)})
    right_keys = [f"_k{i}" for i in range(len(pairs))]
    renamed = [(a, k) for (a, _), k in zip(pairs, right_keys)]

    if use_estimate and planned_small(lookup):
        return df.join(lookup, key_match(df, lookup, renamed, null_safe), how).drop(*right_keys)
    if measure and within_broadcast(lookup):
        return df.join(F.broadcast(lookup), key_match(df, lookup, renamed, null_safe), how).drop(*right_keys)
    if generates(lookup):
        # Without this the planner would send it to every executor on an estimate that is far too low.
        lookup = lookup.hint("merge")
    if often is None and hot == "sample":
        often = hot_keys(sample_from or df, [a for a, _ in pairs], hot_rows)
    if often is None:
        return df.join(lookup, key_match(df, lookup, renamed, null_safe), how).drop(*right_keys)

    marks = often.withColumnsRenamed({a: f"_h{i}" for i, (a, _) in enumerate(pairs)}).withColumn("_hot", F.lit(True))
    left_marks = [(a, f"_h{i}") for i, (a, _) in enumerate(pairs)]
    right_marks = [(k, f"_h{i}") for i, k in enumerate(right_keys)]
    # The salt follows the row and its partition: rows of one key spread also where they came in one partition, equal
    # rows where they came in several, and a task that runs again gives the same salts.
    hashed = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    salt = F.pmod(F.xxhash64(*hashed, F.spark_partition_id()), F.lit(SALTS)).cast("int")
    spread = F.when(F.col("_hot"), salt).otherwise(F.lit(0))
    drop_marks = [h for _, h in left_marks] + ["_hot"]
    left = df.join(marks, key_match(df, marks, left_marks), "left")
    left = left.withColumn("_salt", spread).drop(*drop_marks)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.join(marks, key_match(lookup, marks, right_marks), "left")
    right = right.withColumn("_copy", F.explode(copies)).drop(*drop_marks)
    condition = key_match(left, right, renamed, null_safe) & (left["_salt"] == right["_copy"])
    return left.join(right, condition, how).drop("_salt", "_copy", *right_keys)


def null_safe_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "full",
    suffixes: tuple[str, str] = ("_x", "_y"),
    hot: str | None = "sample",
    hot_rows: int | None = None,
) -> DataFrame:
    """Join on keys where NULL matches NULL. Keys come back once, merged; other columns that both
    tables have get the suffixes.

    Keys with very many rows in either table, NULL among them, are joined by themselves, spread over ``SALTS`` tasks. As
    all rows of a key match or none does, what is unmatched there follows from one flag per key and is added once. ``hot`` is
    'sample' to look for such keys where both tables are larger than what the planner broadcasts, or None.
    """
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    order = [*left.columns, *[c for c in right.columns if c not in keys]]
    marks = None
    if hot == "sample" and not (planned_small(left) or planned_small(right)):
        often = [found for found in (hot_keys(df, keys, hot_rows) for df in (left, right)) if found is not None]
        marks = cut(reduce(lambda x, y: x.unionByName(y), often).distinct(), "hot-keys") if often else None
    if marks is None:
        return _merged(left, right, keys, how).select(*order)

    def flagged(df: DataFrame, table: DataFrame, flag: str) -> DataFrame:
        named = table.withColumnsRenamed({k: f"_h_{k}" for k in keys}).withColumn(flag, F.lit(True))
        return df.join(named, key_match(df, named, [(k, f"_h_{k}") for k in keys]), "left").drop(*[f"_h_{k}" for k in keys])

    left_marked, right_marked = flagged(left, marks, "_hot"), flagged(right, marks, "_hot")
    cold = _merged(left_marked.where("_hot IS NULL").drop("_hot"), right_marked.where("_hot IS NULL").drop("_hot"), keys, how)
    left_hot, right_hot = left_marked.where("_hot").drop("_hot"), right_marked.where("_hot").drop("_hot")
    both = cut(_merged(left_hot.select(*keys).distinct(), right_hot.select(*keys).distinct(), keys, "inner"), "both-sides")
    left_met, right_met = flagged(left_hot, both, "_met"), flagged(right_hot, both, "_met")
    hashed = [F.col(f"`{f.name}`") for f in left.schema if "map<" not in f.dataType.simpleString()]
    salt = F.pmod(F.xxhash64(*hashed, F.spark_partition_id()), F.lit(SALTS)).cast("int")
    spread = left_met.where("_met").drop("_met").withColumn("_salt", salt)
    copies = right_met.where("_met").drop("_met").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parts = [cold, _merged(spread, copies.hint("merge"), [*keys, "_salt"], "inner").drop("_salt")]
    if how in ("full", "left"):
        parts.append(left_met.where("_met IS NULL").drop("_met"))
    if how in ("full", "right"):
        parts.append(right_met.where("_met IS NULL").drop("_met"))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).select(*order)


def _merged(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A null-safe join whose keys come back once."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    joined = left.join(right, key_match(left, right, [(k, f"_r_{k}") for k in keys]), how)
    if how in ("full", "right"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"_r_{k}")) for k in keys})
    return joined.drop(*[f"_r_{k}" for k in keys])


def keyed_inner(left: DataFrame, right: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Inner join on keys that carry different names; the right-hand names are dropped."""
    return lookup_join(left, right, on, "inner")


def keep_units(df: DataFrame, units: DataFrame, key: str, unique: bool = False) -> DataFrame:
    """Rows whose unit is listed. As in SQL, a missing unit id never matches. ``unique`` says that a unit
    has one row in ``df``."""
    listed = units.select(key).where(F.col(key).isNotNull()).distinct()
    return lookup_join(df, listed, [key], "inner", null_safe=False, hot=None if unique else "sample")


def either_side_listed(
    bridge: DataFrame, left_id: str, left_units: DataFrame, right_id: str, right_units: DataFrame
) -> DataFrame:
    """Bridge rows whose left id is in the first list or whose right id is in the second.

    Two flag joins and a filter: an OR inside one join condition would compare every pair of rows.
    """
    first = left_units.select(F.col(left_units.columns[0]).alias("_id")).distinct().withColumn("_hit_left", F.lit(True))
    second = right_units.select(F.col(right_units.columns[0]).alias("_id")).distinct().withColumn("_hit_right", F.lit(True))
    marked = lookup_join(bridge, first, {left_id: "_id"}, null_safe=False)
    marked = lookup_join(marked, second, {right_id: "_id"}, null_safe=False, sample_from=bridge)
    hit = F.coalesce(F.col("_hit_left"), F.col("_hit_right"), F.lit(False))
    return marked.where(hit).drop("_hit_left", "_hit_right")


def id_coverage(first: DataFrame, second: DataFrame, names: tuple[str, str]) -> DataFrame:
    """How far two id columns cover each other: rows, rows whose id the other side lacks, and the share.

    The rows of both sides are counted per id in one aggregate, so an id that fills one side costs no
    more than any other.
    """
    a = first.select(F.col(first.columns[0]).alias("_id"), F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    b = second.select(F.col(second.columns[0]).alias("_id"), F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    per_id = a.unionByName(b).groupBy("_id").agg(F.sum("_a").alias("na"), F.sum("_b").alias("nb"))
    totals = per_id.agg(
        F.coalesce(F.sum("na"), F.lit(0)).alias("rows_a"),
        F.coalesce(F.sum(F.when(F.col("nb") == 0, F.col("na"))), F.lit(0)).alias("miss_a"),
        F.coalesce(F.sum("nb"), F.lit(0)).alias("rows_b"),
        F.coalesce(F.sum(F.when(F.col("na") == 0, F.col("nb"))), F.lit(0)).alias("miss_b"),
    )
    sides = F.array(
        F.struct(F.lit(names[0]).alias("side"), F.col("rows_a").alias("n_rows"), F.col("miss_a").alias("n_missing")),
        F.struct(F.lit(names[1]).alias("side"), F.col("rows_b").alias("n_rows"), F.col("miss_b").alias("n_missing")),
    )
    return totals.select(F.inline(sides)).withColumn("share_missing", ratio(F.col("n_missing"), F.col("n_rows")))


def link_periods(
    bridge: DataFrame,
    first: DataFrame,
    second: DataFrame,
    bridge_ids: tuple[str, str],
    record_id: str,
    suffixes: tuple[str, str] = ("_1940", "_1950"),
    both: bool = True,
) -> DataFrame:
    """Attach each period's records to a bridge of (first id, second id) rows.

    With ``both`` only links found in the two periods stay; otherwise the missing side is NULL.
    """
    linked = bridge
    for side, bridge_id, suffix in zip((first, second), bridge_ids, suffixes):
        side = side.withColumnsRenamed({c: c + suffix for c in side.columns if c != record_id})
        side = side.withColumn(f"_found{suffix}", F.lit(True))
        how = "inner" if both else "left"
        linked = lookup_join(linked, side, {bridge_id: record_id}, how, null_safe=False, sample_from=bridge)
    return linked.drop(*[f"_found{s}" for s in suffixes])


def fold_full_join(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer join of many tables on one key that is unique in each of them.

    The tables are stacked and grouped by key once, so N tables cost one shuffle instead of N - 1. A key
    that repeats inside one table raises an error.
    """
    taken = {key}
    stacked = None
    columns: list[str] = []
    for index, frame in enumerate(frames):
        own = [c for c in frame.columns if c != key]
        clash = taken & set(own)
        if clash:
            raise ValueError(f"columns in more than one table: {sorted(clash)}")
        taken |= set(own)
        columns += own
        tagged = frame.withColumn("_table", F.lit(index))
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    owner = {c: index for index, frame in enumerate(frames) for c in frame.columns if c != key}
    repeats = [F.count_if(F.col("_table") == index) for index in range(len(frames))]
    picked = [F.max(F.when(F.col("_table") == owner[c], F.col(c))).alias(c) for c in columns]
    grouped = stacked.groupBy(key).agg(F.greatest(*repeats, F.lit(0)).alias("_most"), *picked)
    checked = F.when(F.col("_most") > 1, F.raise_error(F.lit(f"{key} repeats inside one table")).cast("boolean"))
    return grouped.where(F.coalesce(checked, F.lit(True))).select(key, *columns)


def recode_columns(
    df: DataFrame,
    columns: Sequence[str],
    dictionary: DataFrame,
    code: str = "code",
    value: str = "value",
    keep_unmatched: bool = False,
) -> DataFrame:
    """Replace the codes in several columns by the values of a dictionary table with unique codes."""
    order = df.columns
    named = {c: dictionary.select(F.col(code).alias("_code"), F.col(value).alias(f"_value_{i}")) for i, c in enumerate(columns)}
    df = lookup_chain(df, [Lookup(entries, {c: "_code"}, null_safe=False, measure=True) for c, entries in named.items()])
    values = {c: F.col(f"_value_{i}") for i, c in enumerate(columns)}
    return df.withColumns({c: F.coalesce(v, F.col(c)) if keep_unmatched else v for c, v in values.items()}).select(*order)


def label_codes(df: DataFrame, labels: DataFrame, columns: Sequence[str], suffix: str = "_label") -> DataFrame:
    """Add a label column for each coded column, from a (variable, code, label) table. Do this last,
    on aggregated rows where possible."""
    def of_column(column: str) -> DataFrame:
        code = F.col("code").try_cast(df.schema[column].dataType).alias("_code")
        return labels.where(F.col("variable") == column).select(code, F.col("label").alias(column + suffix))

    return lookup_chain(df, [Lookup(of_column(c), {c: "_code"}, null_safe=False, measure=True) for c in columns])
