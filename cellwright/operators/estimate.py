"""Least squares and logit on tables of any length.

One aggregate gives the count and the cross products of all columns; coefficients are solved from these few numbers. Absorbed
factors are taken out of the rows first (``operators.absorb``), so that only counts and sums are shuffled by level. Clustered
and robust errors come after the coefficients, from scores: sums of regressor times residual. Segments are solved in
batches by the executors and stay a table, however many there are. A fit of a whole table remembers its rows, so that other
errors can be asked for later.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cellwright.functions.tails import f_upper
from cellwright.operators.absorb import SMALL_CELLS, dependent_levels, sweep_rows
from cellwright.operators.design import Term, expand_terms, source_columns
from cellwright.operators.joins import lookup_join
from cellwright.operators.solve import FIT_FIELDS, Fit, Layout, finish_batches, finished, independent_columns, outer_names, read_outer, solve_batches, solved
from cellwright.session import cut, in_tasks

__all__ = [
    "Fit", "fit_pass", "fit_statistics_of", "fit_subsets", "fit_table", "independent_columns", "linear_models", "logit", "multi_outcome", "ols",
    "ols_by_segment", "segment_models", "segment_table", "stats_table", "subset_models", "sweep", "wald", "with_errors",
]

FIT_SCHEMA = "outcome string, term string, estimate double, std_error double, statistic double, p_value double, n bigint"


def fit_table(spark: SparkSession, fits: Mapping[str, Fit] | Sequence[Fit]) -> DataFrame:
    """Coefficient table of one or more fits. Segment columns, and the name of the fit, come first."""
    named = list(fits.items()) if isinstance(fits, Mapping) else [(None, fit) for fit in fits]
    segment_names = list(named[0][1].segment)
    rows, types = [], ["fit string"] if named[0][0] is not None else []
    types += [f"`{s}` string" for s in segment_names]
    for name, fit in named:
        head = ([name] if name is not None else []) + [_text(fit.segment[s]) for s in segment_names]
        rows += [(*head, *row) for row in fit.rows()]
    return spark.createDataFrame(rows, ", ".join([*types, FIT_SCHEMA]))


def stats_table(spark: SparkSession, fits: Mapping[str, Fit]) -> DataFrame:
    """Fit statistics, one row per fit and statistic."""
    rows = [(name, fit.outcome, stat, float(v)) for name, fit in fits.items() for stat, v in fit.stats.items()]
    return spark.createDataFrame(rows, "fit string, outcome string, stat string, value double")


def _text(value: object) -> str | None:
    return None if value is None else str(value)


class _Columns:
    """The numeric columns of a set of models, centred and scaled to unit spread.

    Without this step the cross products of a year and its square would lose most of their digits. ``keys`` must be known for
    a row to count; ``keep`` are carried along as they are.
    """

    def __init__(self, df: DataFrame, named: Mapping[str, Column], keys: Sequence[str], keep: Sequence[str] = ()):
        self.names = list(named)
        self.short = {name: f"z{i}" for i, name in enumerate(self.names)}
        raw = df.select(*keys, *keep, *[c.alias(self.short[n]) for n, c in named.items()])
        whole = F.lit(True)
        for c in [*keys, *self.short.values()]:
            whole = whole & F.col(c).isNotNull()
        counted = raw.agg(
            F.count("*").alias("n_all"),
            F.count_if(whole).alias("n"),
            *[F.avg(F.when(whole, F.col(z))).alias(f"m_{z}") for z in self.short.values()],
            *[F.stddev_pop(F.when(whole, F.col(z))).alias(f"d_{z}") for z in self.short.values()],
        ).first()
        complete = raw.where(whole)
        self.n = counted["n"]
        self.n_missing = counted["n_all"] - counted["n"]
        self.center = {n: float(counted[f"m_{z}"] or 0.0) for n, z in self.short.items()}
        spread = {n: float(counted[f"d_{z}"] or 0.0) for n, z in self.short.items()}
        self.scale = {n: spread[n] if spread[n] > 1e-12 * (1.0 + abs(self.center[n])) else 1.0 for n in self.names}
        #: Sums of squares of the scaled columns.
        self.raw = {z: self.n * (spread[n] / self.scale[n]) ** 2 for n, z in self.short.items()}
        scaled = [
            ((F.col(z) - F.lit(self.center[n])) / F.lit(self.scale[n])).alias(z) for n, z in self.short.items()
        ]
        self.rows = complete.select(*keys, *keep, *scaled)


class _CellColumns(_Columns):
    """The same for cells that stand for ``_n`` rows each."""

    def __init__(self, cells: DataFrame, named: Mapping[str, Column], keys: Sequence[str]):
        self.names = list(named)
        self.short = {name: f"z{i}" for i, name in enumerate(self.names)}
        raw = cells.select(*keys, "_n", "_y", *[c.alias(self.short[n]) for n, c in named.items()])
        sums = [F.sum("_n").alias("n"), *[(F.sum(F.col("_n") * F.col(z)) / F.sum("_n")).alias(f"m_{z}") for z in self.short.values()]]
        first = raw.agg(*sums).first()
        self.n = first["n"]
        self.center = {n: float(first[f"m_{z}"]) for n, z in self.short.items()}
        squares = [F.sum(F.col("_n") * (F.col(z) - F.lit(self.center[n])) ** 2).alias(z) for n, z in self.short.items()]
        found = raw.agg(F.count("*").alias("cells"), *squares).first()
        spread = {n: math.sqrt(float(found[z]) / self.n) for n, z in self.short.items()}
        self.scale = {n: spread[n] if spread[n] > 1e-12 * (1.0 + abs(self.center[n])) else 1.0 for n in self.names}
        self.rows = raw.select(*keys, "_n", "_y", *[((F.col(z) - F.lit(self.center[n])) / F.lit(self.scale[n])).alias(z) for n, z in self.short.items()])


def _residual(layout: Layout, values: Sequence[Column]) -> Column:
    return reduce(lambda left, pair: left - F.col(pair[0]) * pair[1], zip(layout.regressors, values), F.col(layout.y))


def _outer(scores: Sequence[Column], tag: str = "m", weight: Column | None = None) -> list[Column]:
    pairs = [(a, c) for i, a in enumerate(scores) for c in scores[i:]]
    products = [a * c if weight is None else a * c * weight for a, c in pairs]
    return [F.sum(p).alias(n) for p, n in zip(products, outer_names(len(scores), tag))]


class _Pass:
    """Rows that several models share: without their factors' effects, and with the sums that the models are solved from."""

    def __init__(
        self,
        df: DataFrame,
        models: Mapping[str, tuple[str, Sequence[Term]]],
        segment: Sequence[str],
        absorb: Sequence[str],
        cluster: str | None,
        keep: Sequence[str],
        degrees: str,
        most_rounds: int,
        small_cells: int,
    ):
        required = list(dict.fromkeys([*segment, *absorb, *([cluster] if cluster else [])]))
        kept = [c for c in dict.fromkeys(keep) if c not in required]
        named: dict[str, Column] = {}
        layout: dict[str, tuple[str, list[str]]] = {}
        for name, (outcome, terms) in models.items():
            named[outcome] = F.col(outcome).cast("double")
            expanded = expand_terms(df, terms)
            named.update(expanded)
            layout[name] = (outcome, [t for t, _ in expanded])
        columns = _Columns(df, named, required, kept)
        if not columns.n:
            raise ValueError(f"no row is complete in the columns of {list(models)}")
        self.n_missing, self.segment, self.absorb, self.kept = columns.n_missing, list(segment), list(absorb), {*required, *kept}
        z = list(columns.short.values())
        self.rounds = 0
        if absorb:
            swept = sweep_rows(columns.rows, segment, absorb, z, most_rounds, small_cells)
            self.rows, self.rounds = cut(swept.rows, "swept"), swept.rounds
            self.cells = self.rows if swept.cells is None else swept.cells
        else:
            self.rows = columns.rows.withColumn("one", F.lit(1.0))
        self.columns = z if absorb else ["one", *z]
        shared = dict(center=columns.center, scale=columns.scale, swept=bool(absorb), columns=tuple(self.columns), factors=tuple(absorb))
        self.layouts = {
            name: Layout(outcome, tuple(terms), columns.short[outcome], (*(() if absorb else ("one",)), *[columns.short[t] for t in terms]), **shared)
            for name, (outcome, terms) in layout.items()
        }
        pairs = [(a, b) for i, a in enumerate(self.columns) for b in self.columns[i:]]
        sums = [F.count("*").cast("double").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs]]
        totals = self.rows.groupBy(*segment).agg(*sums)
        if not absorb:
            totals = totals.withColumns({**{f"s_{a}": F.col(f"p_one_{a}") for a in z}, **{f"raw_{a}": F.col(f"p_{a}_{a}") for a in z}})
        elif segment:
            before = columns.rows.groupBy(*segment).agg(*[F.sum(a).alias(f"s_{a}") for a in z], *[F.sum(F.col(a) * F.col(a)).alias(f"raw_{a}") for a in z])
            totals = totals.join(before, list(segment))
        else:
            totals = totals.withColumns({**{f"s_{a}": F.lit(0.0) for a in z}, **{f"raw_{a}": F.lit(columns.raw[a]) for a in z}})
        for factor in absorb:
            level = list(dict.fromkeys([*segment, factor]))
            levels = swept.levels.get(factor, self.cells).select(*level).distinct()
            sizes = levels.groupBy(*segment).agg(F.count("*").cast("double").alias(f"l_{factor}"))
            totals = totals.join(sizes, list(segment)) if segment else totals.withColumn(f"l_{factor}", F.lit(float(sizes.first()[0])))
        if absorb:
            if degrees == "components" and len(absorb) > 1:
                found = dependent_levels(self.cells, segment, absorb)
                totals = totals.join(found, list(segment)) if segment else totals.withColumn("dependent", F.lit(found.first()["dependent"]))
            else:
                totals = totals.withColumn("dependent", F.lit(len(absorb) - 1))
        self.fields = [c for c in totals.columns if c not in segment]
        numbers = F.array(*[F.col(f"`{c}`").cast("double") for c in self.fields]).alias("numbers")
        if segment:
            # The number of a segment is settled once the table is written.
            self.totals = cut(totals.select(*segment, numbers).withColumn("_s", F.monotonically_increasing_id()), "totals")
        else:
            self.total = dict(zip(self.fields, totals.select(numbers).first()["numbers"]))

    def nested(self, cluster: str) -> frozenset[str]:
        """Factors each of whose levels lies in one cluster."""
        found = set()
        for f in self.absorb:
            spans = self.rows.groupBy(*dict.fromkeys([*self.segment, f])).agg(F.min(cluster).alias("_lo"), F.max(cluster).alias("_hi"))
            if f == cluster or spans.where(F.col("_lo") != F.col("_hi")).isEmpty():
                found.add(f)
        return frozenset(found)

    def _sums(self, rows: DataFrame, by: Sequence[str], layout: Layout, values: Sequence[Column], vcov: str, cluster: str | None) -> DataFrame:
        """The middle of the sandwich: outer products of scores, of rows or of clusters."""
        residual = _residual(layout, values)
        if vcov == "hc1":
            outer = _outer([F.col(a) for a in layout.regressors], weight=residual * residual)
            return rows.groupBy(*by).agg(F.count("*").alias("groups"), F.lit(0).alias("unknown"), *outer)
        scores = rows.groupBy(*by, F.col(cluster).alias("_c")).agg(*[F.sum(F.col(a) * residual).alias(f"_u{j}") for j, a in enumerate(layout.regressors)])
        outer = _outer([F.col(f"_u{j}") for j in range(len(layout.regressors))])
        return scores.groupBy(*by).agg(F.count("*").alias("groups"), F.count_if(F.col("_c").isNull()).alias("unknown"), *outer)

    def fit(self, name: str, vcov: str, cluster: str | None) -> Fit:
        """One model on all rows."""
        layout = self.layouts[name]
        solution, meat, groups = solved(self.total, layout), None, None
        if vcov != "iid":
            values = [F.lit(b) for b in solution.padded(len(layout.regressors))]
            row = self._sums(self.rows, [], layout, values, vcov, cluster).first()
            if row["unknown"]:
                raise ValueError(f"{cluster} is missing in some rows of the fit")
            meat, groups = read_outer(row, len(layout.regressors)), row["groups"]
        if vcov == "cluster" and self.absorb:
            layout = replace(layout, nested=self.nested(cluster))
        fit = finished(self.total, layout, solution, vcov, meat, groups)
        fit.n_missing, fit.source = self.n_missing, (self, name)
        if self.absorb:
            fit.stats["rounds"] = float(self.rounds)
        return fit

    def _dealt(self, segments: DataFrame) -> DataFrame:
        """Segments dealt to all cores: they are few bytes but much work, so sizes would put them into few tasks."""
        return segments.repartition(segments.sparkSession.sparkContext.defaultParallelism, "_s")

    def segments(self, vcov: str, cluster: str | None) -> DataFrame:
        """Every model on every segment, as a table: segment columns and ``FIT_FIELDS``."""
        layouts = self.layouts
        if vcov == "cluster" and self.absorb:
            nested = self.nested(cluster)
            layouts = {name: replace(layout, nested=nested) for name, layout in layouts.items()}
        types = "model string, meat array<double>, groups bigint"
        if vcov == "iid":
            known = self.totals.select("_s", "numbers", *[F.lit(None).cast(t).alias(n) for n, t in (p.split(" ") for p in types.split(", "))])
        else:
            found = cut(in_tasks(self._dealt(self.totals.select("_s", "numbers")), solve_batches(self.fields, layouts), "_s bigint, _model string, _b array<double>"), "coefficients")
            found = self.totals.select(*self.segment, "_s").join(found, "_s")
            meats = []
            for name, layout in layouts.items():
                of_model = found.where(F.col("_model") == name).select(*self.segment, "_s", "_b")
                rows = lookup_join(self.rows, of_model, self.segment, "inner", null_safe=False)
                values = [F.col("_b")[j] for j in range(len(layout.regressors))]
                sums = self._sums(rows, ["_s"], layout, values, vcov, cluster)
                meats.append(sums.select("_s", F.lit(name).alias("model"), F.array(*outer_names(len(layout.regressors))).alias("meat"), "groups"))
            meats = reduce(lambda a, b: a.unionByName(b), meats)
            known = self.totals.select("_s", "numbers").join(meats, "_s").select("_s", "numbers", "model", "meat", "groups")
        fits = in_tasks(self._dealt(known), finish_batches(self.fields, layouts, vcov), f"_s bigint, {FIT_FIELDS}")
        return self.totals.select(*self.segment, "_s").join(fits, "_s").drop("_s")


def _passes(
    df: DataFrame,
    models: Mapping[str, tuple[str, Sequence[Term]]],
    absorb: Sequence[str] = (),
    vcov: str = "iid",
    cluster: str | None = None,
    segment: Sequence[str] = (),
    most_rounds: int = 500,
    keep: Sequence[str] = (),
    degrees: str = "levels",
    small_cells: int = SMALL_CELLS,
) -> dict[str, _Pass]:
    """Each model's pass. Models that use the same rows share one, the others get one each."""
    if vcov not in ("iid", "hc1", "cluster") or (vcov == "cluster") != (cluster is not None):
        raise ValueError("vcov is 'iid', 'hc1', or 'cluster' with a cluster column")
    if degrees not in ("levels", "components"):
        raise ValueError("degrees is 'levels' or 'components'")
    keys = list(dict.fromkeys([*segment, *absorb, *([cluster] if cluster else [])]))
    options = (segment, absorb, cluster, keep, degrees, most_rounds, small_cells)
    if len(models) > 1 and not _same_rows(df, models, keys):
        return {name: _Pass(df, {name: model}, *options) for name, model in models.items()}
    shared = _Pass(df, models, *options)
    return {name: shared for name in models}


def fit_pass(df: DataFrame, outcome: str, terms: Sequence[Term], **options) -> _Pass:
    """The pass of one model on the whole table, for what is worked out from its cells and sums."""
    return _passes(df, {outcome: (outcome, terms)}, **options)[outcome]


def linear_models(
    df: DataFrame, models: Mapping[str, tuple[str, Sequence[Term]]], vcov: str = "iid", cluster: str | None = None, segment: Sequence[str] = (), **options
) -> dict[str, list[Fit]]:
    """Fit several linear models on one table, each on every segment.

    ``models`` maps a name to (outcome, terms). ``absorb`` lists fixed-effect factors, ``vcov`` is 'iid',
    'hc1' or 'cluster'. Rows with a missing value in any column of a model are left out. Models that use the
    same rows share one pass over the table; the others get a pass each. Several factors that have not settled
    after ``most_rounds`` rounds are an error, as is a table without a complete row.

    Absorbed levels count as parameters, less one for every factor but the first; with ``degrees`` 'components', less the
    parts into which the levels fall apart. ``keep`` names columns by which errors may be clustered later (``with_errors``).
    The fits of segments are brought to the driver here; ``segment_models`` gives the same as a table.
    """
    passes = _passes(df, models, vcov=vcov, cluster=cluster, segment=segment, **options)
    if not segment:
        return {name: [shared.fit(name, vcov, cluster)] for name, shared in passes.items()}
    result: dict[str, list[Fit]] = {name: [] for name in models}
    for shared in dict.fromkeys(passes.values()):
        for row in shared.segments(vcov, cluster).toLocalIterator():
            k = len(row["terms"])
            fit = Fit(
                row["outcome"], row["terms"], np.array(row["coef"]), np.array(row["vcov"]).reshape(k, k), row["n"], row["n_params"], row["df_t"], vcov,
                dict(zip(row["stat_names"], row["stat_values"])), row["dropped"], shared.n_missing, {s: row[s] for s in segment},
            )
            result[row["fit"]].append(fit)
    return result


def segment_models(
    df: DataFrame, models: Mapping[str, tuple[str, Sequence[Term]]], segment: Sequence[str], vcov: str = "iid", cluster: str | None = None, **options
) -> DataFrame:
    """The fits of every model on every segment as a table, solved on the executors; nothing of a segment reaches the driver.

    Columns: the segment's, and ``FIT_FIELDS`` with terms, coefficients, errors and the covariance (by rows) as arrays.
    """
    passes = _passes(df, models, vcov=vcov, cluster=cluster, segment=segment, **options)
    tables = [shared.segments(vcov, cluster) for shared in dict.fromkeys(passes.values())]
    return reduce(lambda a, b: a.unionByName(b), tables)


def segment_table(fits: DataFrame) -> DataFrame:
    """One row per coefficient of the fits that ``segment_models`` gives."""
    each = F.explode(F.arrays_zip("terms", "coef", "std_error", "statistic", "p_value"))
    others = [c for c in fits.columns if c not in {part.split(" ")[0] for part in FIT_FIELDS.split(", ")}]
    rows = fits.select(*others, "fit", "outcome", each.alias("e"), "n")
    named = {"terms": "term", "coef": "estimate", "std_error": "std_error", "statistic": "statistic", "p_value": "p_value"}
    return rows.select(*others, "fit", "outcome", *[F.col(f"e.{a}").alias(b) for a, b in named.items()], "n")


def fit_statistics_of(fits: DataFrame) -> DataFrame:
    """One row per statistic of the fits that ``segment_models`` gives."""
    others = [c for c in fits.columns if c not in {part.split(" ")[0] for part in FIT_FIELDS.split(", ")}]
    rows = fits.select(*others, "fit", "outcome", F.explode(F.arrays_zip("stat_names", "stat_values")).alias("e"))
    return rows.select(*others, "fit", "outcome", F.col("e.stat_names").alias("stat"), F.col("e.stat_values").alias("value"))


def with_errors(fit: Fit, vcov: str, cluster: str | None = None) -> Fit:
    """The same fit with errors of another kind, from the rows that it keeps; ``cluster`` is a key or kept column of it."""
    if vcov not in ("iid", "hc1", "cluster") or (vcov == "cluster") != (cluster is not None):
        raise ValueError("vcov is 'iid', 'hc1', or 'cluster' with a cluster column")
    if fit.source is None:
        raise ValueError("only a linear fit of a whole table keeps its rows")
    shared, name = fit.source
    if cluster and cluster not in shared.kept:
        raise ValueError(f"{cluster} was not kept; name it in keep= when fitting")
    return shared.fit(name, vcov, cluster)


def _same_rows(df: DataFrame, models: Mapping[str, tuple[str, Sequence[Term]]], keys: Sequence[str]) -> bool:
    """Whether every model has the same complete rows, told by one count of each."""
    tests = {}
    for i, (outcome, terms) in enumerate(models.values()):
        used = list(dict.fromkeys([outcome, *[c for t in terms for c in source_columns(t)], *keys]))
        test = F.lit(True)
        for c in used:
            test = test & F.col(c).isNotNull()
        tests[f"t{i}"] = test
    together = F.lit(True)
    for test in tests.values():
        together = together & test
    counts = df.agg(F.count_if(together).alias("all"), *[F.count_if(t).alias(n) for n, t in tests.items()]).first()
    return all(counts[n] == counts["all"] for n in tests)


def ols(df: DataFrame, outcome: str, terms: Sequence[Term], **options) -> Fit:
    """One linear model on the whole table."""
    return linear_models(df, {outcome: (outcome, terms)}, **options)[outcome][0]


def ols_by_segment(df: DataFrame, outcome: str, terms: Sequence[Term], segment: Sequence[str], **options) -> list[Fit]:
    """The same model on every segment, in one pass; for few segments, see ``segment_models``."""
    return linear_models(df, {outcome: (outcome, terms)}, segment=segment, **options)[outcome]


def multi_outcome(df: DataFrame, outcomes: Sequence[str], terms: Sequence[Term], **options) -> dict[str, Fit]:
    """Several outcomes on the same regressors."""
    fits = linear_models(df, {y: (y, terms) for y in outcomes}, **options)
    return {name: found[0] for name, found in fits.items()}


def sweep(
    df: DataFrame, outcome: str, candidates: Sequence[str], terms: Sequence[Term], **options
) -> dict[str, Fit]:
    """The same model once per candidate regressor, which is put before the other terms."""
    fits = linear_models(df, {c: (outcome, [c, *terms]) for c in candidates}, **options)
    return {name: found[0] for name, found in fits.items()}


def _tagged(df: DataFrame, subsets: Mapping[str, Column | None]) -> DataFrame:
    tags = [
        F.lit(name) if condition is None else F.when(condition, F.lit(name)) for name, condition in subsets.items()
    ]
    return df.withColumn("_subset", F.explode(F.array_compact(F.array(*tags))))


def subset_models(df: DataFrame, subsets: Mapping[str, Column | None], outcome: str, terms: Sequence[Term], **options) -> DataFrame:
    """The same model on filtered subsets as a table, ``fit`` being the subset's name; see ``fit_subsets``."""
    fits = segment_models(_tagged(df, subsets), {outcome: (outcome, terms)}, ["_subset"], **options)
    return fits.withColumn("fit", F.col("_subset")).drop("_subset")


def fit_subsets(
    df: DataFrame, subsets: Mapping[str, Column | None], outcome: str, terms: Sequence[Term], **options
) -> dict[str, Fit]:
    """The same model on filtered subsets, which may overlap; None stands for all rows.

    A row is counted into every subset it belongs to, so one pass serves all of them. Levels of text
    regressors are those of the whole table.
    """
    fits = {fit.segment["_subset"]: fit for fit in ols_by_segment(_tagged(df, subsets), outcome, terms, ["_subset"], **options)}
    for fit in fits.values():
        fit.segment = {}
    return {name: fits[name] for name in subsets if name in fits}


def wald(fit: Fit, pattern: str, vcov: str | None = None, cluster: str | None = None) -> dict[str, object]:
    """Joint test that every coefficient whose name matches the pattern is zero.

    With ``vcov`` or ``cluster`` the test takes errors of that kind, whatever those of the fit are.
    """
    if vcov or cluster:
        fit = with_errors(fit, vcov or "cluster", cluster)
    chosen = [j for j, t in enumerate(fit.terms) if re.search(pattern, t)]
    if not chosen:
        raise ValueError(f"no coefficient matches {pattern!r}")
    b = fit.coef[chosen]
    v = fit.vcov[np.ix_(chosen, chosen)]
    stat = float(b @ np.linalg.solve(v, b)) / len(chosen)
    df2 = fit.n - fit.n_params
    return {"stat": stat, "p": f_upper(stat, len(chosen), df2), "df1": len(chosen), "df2": df2, "vcov": fit.vcov_type}


def logit(
    df: DataFrame,
    outcome: str,
    terms: Sequence[Term],
    cluster: str | None = None,
    tolerance: float = 1e-10,
    max_steps: int = 25,
) -> Fit:
    """Logistic regression by Newton steps over cells of equal covariates.

    The table is read once: rows that agree in all source columns, and in the cluster, become one cell with their count and
    the sum of their outcomes. Each step is one aggregate over the cells. The outcome is 0 or 1. If some combination of regressors
    tells the outcomes apart fully there is no finite estimate, and this raises an error, as does a fit that has
    not settled after ``max_steps`` steps.
    """
    sources = list(dict.fromkeys(c for t in terms for c in source_columns(t)))
    keys = [cluster] if cluster else []
    everything = list(dict.fromkeys([*keys, *sources]))
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*everything, outcome]])
    seen = Observation("rows")
    rows = df.select(*dict.fromkeys([*everything, outcome])).observe(seen, F.count(F.lit(1)).alias("n"))
    grouped = rows.where(known).groupBy(*everything).agg(F.count("*").alias("_n"), F.sum(F.col(outcome).cast("double")).alias("_y"))
    cells = cut(grouped, "covariates")
    if cells.isEmpty():
        raise ValueError(f"no row is complete in {everything} and {outcome}")
    columns = _CellColumns(cells, dict(expand_terms(cells, terms)), keys)
    n, n_missing = columns.n, seen.get["n"] - columns.n
    rows = cut(columns.rows.withColumn("one", F.lit(1.0)), "logit")
    regressors = ["one", *columns.short.values()]
    gram_row = rows.agg(*_outer([F.col(a) for a in regressors], "g", F.col("_n"))).first()
    used = [regressors[j] for j in independent_columns(read_outer(gram_row, len(regressors), "g"))]

    b = np.zeros(len(used))
    deviance = math.inf
    for _ in range(max_steps):
        eta = F.lit(0.0)
        for a, value in zip(used, b):
            eta = eta + F.col(a) * F.lit(float(value))
        p = 1.0 / (1.0 + F.exp(-F.col("_eta")))
        step = rows.withColumn("_eta", eta).withColumn("_p", p)
        log_one_plus = F.greatest(F.col("_eta"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("_eta")))
        gradient = [F.sum(F.col(a) * (F.col("_y") - F.col("_n") * F.col("_p"))).alias(f"d_{i}") for i, a in enumerate(used)]
        found = step.agg(
            *_outer([F.col(a) for a in used], "h", F.col("_n") * F.col("_p") * (1.0 - F.col("_p"))),
            *gradient,
            F.sum(F.col("_y") * F.col("_eta") - F.col("_n") * log_one_plus).alias("ll"),
            F.sum(F.col("_y") * (1.0 - 2.0 * F.col("_p")) + F.col("_n") * F.col("_p") * F.col("_p")).alias("sse"),
            (F.sum("_y") / F.sum("_n")).alias("base"),
        ).first()
        hessian = read_outer(found, len(used), "h")
        new_deviance = -2.0 * float(found["ll"])
        done = abs(new_deviance - deviance) / (0.1 + abs(new_deviance)) < tolerance
        deviance = new_deviance
        if done:
            break
        b = b + np.linalg.solve(hessian, np.array([float(found[f"d_{i}"]) for i in range(len(used))]))
        if not np.all(np.isfinite(b)) or deviance < 1e-8 * n:
            raise RuntimeError("the regressors separate the outcomes; there is no finite estimate")
    else:
        raise RuntimeError(f"no convergence in {max_steps} steps; the outcomes may be separated")

    bread = np.linalg.inv(hessian)
    v, df_t, kind = bread, n - len(used), "iid"
    if cluster:
        scores = [F.sum(F.col(a) * (F.col("_y") - F.col("_n") * F.col("_p"))).alias(f"_s{i}") for i, a in enumerate(used)]
        per_cluster = step.groupBy(cluster).agg(*scores)
        sums = per_cluster.agg(
            F.count("*").alias("groups"), *_outer([F.col(f"_s{i}") for i in range(len(used))], "m")
        ).first()
        groups = sums["groups"]
        factor = (groups / (groups - 1)) * ((n - 1) / (n - len(used)))
        v = bread @ read_outer(sums, len(used), "m") @ bread * factor
        df_t, kind = groups - 1, "cluster"

    names = {z: t for t, z in columns.short.items()}
    back = np.diag([1.0 if a == "one" else 1.0 / columns.scale[names[a]] for a in used])
    at = used.index("one")
    for j, a in enumerate(used):
        if a != "one":
            back[at, j] = -columns.center[names[a]] / columns.scale[names[a]]
    base = float(found["base"])
    null_ll = n * (base * math.log(base) + (1 - base) * math.log(1 - base)) if 0 < base < 1 else 0.0
    ll = -0.5 * deviance
    labels = ["(Intercept)" if a == "one" else names[a] for a in used]
    stats = {
        "n": n,
        "loglik": ll,
        "aic": deviance + 2 * len(used),
        "bic": deviance + math.log(n) * len(used),
        "pseudo_r2": 1 - ll / null_ll if null_ll else math.nan,
        "rmse": math.sqrt(float(found["sse"]) / n),
    }
    return Fit(
        outcome=outcome,
        terms=labels,
        coef=back @ b,
        vcov=back @ v @ back.T,
        n=n,
        n_params=len(used),
        df_t=df_t,
        vcov_type=kind,
        stats=stats,
        dropped=[names[a] for a in regressors if a not in used],
        n_missing=n_missing,
        normal=True,
    )
