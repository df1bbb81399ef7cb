"""Cell counts, propensity per cell, and attaching it to units."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.functions.numeric import ratio, share_where, total
from cellwright.functions.recode import blank_sentinels, scale_in_period
from cellwright.operators.joins import lookup_join
from cellwright.rules import census
from cellwright.session import cut


def cell_counts(df: DataFrame, keys: Sequence[str], where: Column | None = None, name: str = "n") -> DataFrame:
    """Rows per cell. A missing key value forms a cell of its own."""
    if where is not None:
        df = df.where(where)
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def cell_propensity(
    treated: DataFrame,
    population: DataFrame,
    keys: Sequence[str],
    count: str = "n",
    suffixes: tuple[str, str] = ("_treated", "_population"),
) -> DataFrame:
    """Treated count over population count per cell.

    The result is that of a full outer join of the two count tables in which NULL keys match and absent
    counts are zero. It is computed by stacking the tables and summing per cell: one shuffle of counts.
    A cell without population has no proportion and is marked in ``no_population``.
    """
    first, second = f"{count}{suffixes[0]}", f"{count}{suffixes[1]}"
    zero = F.lit(0).cast("bigint")
    a = treated.select(*keys, F.col(count).cast("bigint").alias(first), zero.alias(second))
    b = population.select(*keys, zero.alias(first), F.col(count).cast("bigint").alias(second))
    summed = a.unionByName(b).groupBy(*keys).agg(total(F.col(first)).alias(first), total(F.col(second)).alias(second))
    return with_proportion(summed, first, second)


def flagged_propensity(
    units: DataFrame, keys: Sequence[str], treated: Column, names: tuple[str, str] = ("n_treated", "n_population")
) -> DataFrame:
    """Propensity per cell where one table holds everybody and a flag marks the treated: one pass."""
    counted = units.groupBy(*keys).agg(
        F.count_if(F.coalesce(treated, F.lit(False))).alias(names[0]), F.count("*").alias(names[1])
    )
    return with_proportion(counted, *names)


def with_proportion(df: DataFrame, treated: str, population: str, name: str = "prop") -> DataFrame:
    return df.withColumn(name, ratio(F.col(treated), F.col(population))).withColumn(
        "no_population", F.col(population) == 0
    )


def propensity_by(
    cells: DataFrame,
    by: Sequence[str],
    treated: str = "n_treated",
    population: str = "n_population",
    name: str = "propensity",
) -> DataFrame:
    """Propensity of coarser cells: sums of both counts, then their ratio."""
    summed = cells.groupBy(*by).agg(total(F.col(treated)).alias(treated), total(F.col(population)).alias(population))
    return summed.withColumn(name, ratio(F.col(treated), F.col(population)))


def attach_propensity(
    units: DataFrame,
    cells: DataFrame,
    by: Sequence[str],
    coarse: Mapping[str, tuple[str, Column]] | None = None,
    threshold: float = 0.5,
    treated: str = "n_treated",
    population: str = "n_population",
) -> DataFrame:
    """Join the propensity of each unit's cell to the unit and compare it with a threshold.

    ``coarse`` maps a key to (group column, expression): the group stands in for the raw key, and is
    derived on either side where it is missing. A unit without a cell keeps NULL in both new columns.
    """
    keys = []
    for key in by:
        if coarse and key in coarse:
            group, expression = coarse[key]
            units = units if group in units.columns else units.withColumn(group, expression)
            cells = cells if group in cells.columns else cells.withColumn(group, expression)
            keys.append(group)
        else:
            keys.append(key)
    grouped = cut(propensity_by(cells, keys, treated, population), "propensity")
    joined = lookup_join(units, grouped, keys)
    return joined.withColumn("exposed", F.col("propensity") > threshold)


def propensity_key_sets(
    cells: DataFrame,
    key_sets: Mapping[str, Sequence[str]],
    treated: str = "n_treated",
    population: str = "n_population",
) -> DataFrame:
    """Propensity under several key sets in one pass. ``key_set`` names the set; keys outside it are NULL."""
    columns = list(dict.fromkeys(k for keys in key_sets.values() for k in keys))
    sets = [[F.col(k) for k in keys] for keys in key_sets.values()]
    # A key outside a set sets its bit, the first column being the highest.
    last = len(columns) - 1
    ids = {
        name: sum(1 << (last - i) for i, k in enumerate(columns) if k not in keys) for name, keys in key_sets.items()
    }
    if len(set(ids.values())) != len(ids):
        raise ValueError("two key sets hold the same keys")
    grouped = cells.groupingSets(sets, *[F.col(c) for c in columns]).agg(
        F.grouping_id().alias("_gid"), total(F.col(treated)).alias(treated), total(F.col(population)).alias(population)
    )
    label = None
    for name, gid in ids.items():
        label = F.when(F.col("_gid") == gid, name) if label is None else label.when(F.col("_gid") == gid, name)
    return grouped.select(
        label.alias("key_set"),
        *columns,
        treated,
        population,
        ratio(F.col(treated), F.col(population)).alias("propensity"),
    )


def key_set_parents(sizes: Mapping[frozenset[str], int], whole: frozenset[str]) -> dict[frozenset[str], frozenset[str]]:
    """For every key set the smallest finer one that it can be summed from; ``whole`` is the finest."""
    known = {**sizes, whole: max(sizes.values(), default=0) + 1}
    parents = {}
    for keys in sizes:
        finer = [other for other in known if keys < other]
        parents[keys] = min(finer, key=lambda other: (known[other], len(other), sorted(other)))
    return parents


def propensity_lattice(
    cells: DataFrame,
    key_sets: Mapping[str, Sequence[str]],
    treated: str = "n_treated",
    population: str = "n_population",
) -> DataFrame:
    """The same for many key sets that contain one another: each is summed from its smallest finer set, not from the cells.

    One estimate of the sets' sizes chooses the finer sets. Sets with the same finer set are summed together, and only
    those that others are summed from are written. An estimate that is off makes more rows to read, never other sums.
    """
    columns = list(dict.fromkeys(k for keys in key_sets.values() for k in keys))
    names = {frozenset(keys): name for name, keys in key_sets.items()}
    if len(names) != len(key_sets):
        raise ValueError("two key sets hold the same keys")
    whole = frozenset(columns)
    base = cells.groupBy(*columns).agg(total(F.col(treated)).alias(treated), total(F.col(population)).alias(population))
    base = cut(base, "lattice")
    others = [keys for keys in names if keys != whole]
    counted = base.agg(*[F.approx_count_distinct(F.struct(*sorted(keys)) if keys else F.lit(1)).alias(f"n{i}") for i, keys in enumerate(others)]).first()
    parents = key_set_parents({keys: counted[f"n{i}"] for i, keys in enumerate(others)}, whole)
    tables, out = {whole: base}, []
    for parent in sorted({whole, *parents.values()}, key=len, reverse=True):
        children = sorted((keys for keys, p in parents.items() if p == parent), key=lambda keys: (-len(keys), sorted(keys)))
        if not children:
            continue
        summed = propensity_key_sets(tables[parent], {names[keys]: sorted(keys) for keys in children}, treated, population)
        if any(keys in parents.values() for keys in children):
            summed = cut(summed, "lattice")
            for keys in children:
                tables[keys] = summed.where(F.col("key_set") == names[keys]).select(*sorted(keys), treated, population)
        missing = [F.lit(None).cast(base.schema[c].dataType).alias(c) for c in columns if c not in summed.columns]
        out.append(summed.select("*", *missing).select("key_set", *columns, treated, population, "propensity"))
    if whole in names:
        share = ratio(F.col(treated), F.col(population)).alias("propensity")
        out.append(base.select(F.lit(names[whole]).alias("key_set"), *columns, treated, population, share))
    return reduce(lambda a, b: a.unionByName(b), out)


def attach_key_sets(units: DataFrame, cells: DataFrame, key_sets: Mapping[str, Sequence[str]], **names: str) -> DataFrame:
    """Attach one propensity column per key set, named after the set."""
    rates = cut(propensity_key_sets(cells, key_sets, **names), "key-sets")
    joined = units
    for name, keys in key_sets.items():
        own = rates.where(F.col("key_set") == name).select(*keys, F.col("propensity").alias(name))
        joined = lookup_join(joined, own, keys, sample_from=units)
    return joined


def area_demographics(
    cells: DataFrame,
    area: Sequence[str],
    group: Column,
    groups: Sequence[str],
    treated: str = "n_treated",
    population: str = "n_population",
    share_of: str | None = None,
) -> DataFrame:
    """One row per area: population by group, in total, the treated, and shares.

    Population and treated counts come from the same cells, so one aggregate does both. An absent
    group counts zero.
    """
    by_group = [total(F.when(group == g, F.col(population))).alias(f"pop_{g}") for g in groups]
    rows = cells.groupBy(*area).agg(
        *by_group, total(F.col(population)).alias("pop_tot"), total(F.col(treated)).alias("treated")
    )
    rows = rows.withColumn("share_tot", ratio(F.col("treated"), F.col("pop_tot")))
    if share_of:
        rows = rows.withColumn(f"share_{share_of}", ratio(F.col("treated"), F.col(f"pop_{share_of}")))
    return rows


def roll_up(
    areas: DataFrame, region: Sequence[str], sums: Sequence[str], flag: str | None, shares: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Sum areas to regions, average a flag, and compute the shares anew."""
    aggregates = [total(F.col(c)).alias(c) for c in sums if c in areas.columns]
    if flag:
        aggregates.append(share_where(F.col(flag)).alias(flag))
    rolled = areas.groupBy(*region).agg(*aggregates)
    return rolled.withColumns({n: ratio(F.col(a), F.col(b)) for n, (a, b) in shares.items()})


def area_income(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    period: str,
    base_period: int,
    factor: float = census.PRICE_FACTOR,
    sentinels: Sequence[tuple] = tuple(census.SENTINELS),
) -> DataFrame:
    """Total, count of the present and mean of money columns per group, after missing-value codes are
    blanked and the base period is put in the prices of the later one."""
    clean = blank_sentinels(df, sentinels)
    clean = clean.withColumns({v: scale_in_period(F.col(v), F.col(period), base_period, factor) for v in values})
    aggregates = []
    for v in values:
        aggregates += [total(F.col(v)).alias(f"total_{v}"), F.count(v).alias(f"nwith_{v}")]
    grouped = clean.groupBy(*keys).agg(*aggregates)
    return grouped.withColumns({f"mean_{v}": ratio(F.col(f"total_{v}"), F.col(f"nwith_{v}")) for v in values})


def ranked_index(
    cells: DataFrame, by: Sequence[str], treated: str = "n_treated", population: str = "n_population", prop: str = "prop"
) -> DataFrame:
    """Count-weighted mean propensity per group, from cells that have a population."""
    held = cells.where(F.col(population) > 0)
    return held.groupBy(*by).agg(
        ratio(F.sum(F.col(prop) * F.col(population)), F.sum(population)).alias("index"),
        total(F.col(population)).alias(population),
        total(F.col(treated)).alias(treated),
    )


def index_bands(ranked: DataFrame, rank: str, k: int, middle: tuple[float, float], value: str = "index") -> DataFrame:
    """Top ``k``, the middle band and bottom ``k`` of a ranked table, stacked with a name for each."""
    top = ranked.orderBy(rank).limit(k).withColumn("band", F.lit("top"))
    mid = ranked.where((F.col(value) > middle[0]) & (F.col(value) < middle[1])).withColumn("band", F.lit("middle"))
    low = ranked.orderBy(F.desc(rank)).limit(k).withColumn("band", F.lit("bottom"))
    return top.unionByName(mid).unionByName(low)
