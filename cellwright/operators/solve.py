"""The k x k part of linear models: coefficients, errors and statistics from sums, for one fit or in batches on executors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from cellwright.functions.tails import normal_two_sided, t_two_sided

PIVOT_TOLERANCE = 1e-10


@dataclass
class Fit:
    """Estimates of one model on one segment."""

    outcome: str
    terms: list[str]
    coef: np.ndarray
    vcov: np.ndarray
    n: int
    n_params: int
    df_t: float
    vcov_type: str
    stats: dict[str, float]
    dropped: list[str] = field(default_factory=list)
    n_missing: int = 0
    segment: dict[str, object] = field(default_factory=dict)
    normal: bool = False
    #: What later errors are worked out from; only fits of a whole table keep it.
    source: object = field(default=None, repr=False, compare=False)

    @property
    def std_error(self) -> np.ndarray:
        return np.sqrt(np.diag(self.vcov))

    def p_values(self) -> list[float]:
        ratios = self.coef / self.std_error
        return [normal_two_sided(r) if self.normal else t_two_sided(r, self.df_t) for r in ratios]

    def rows(self) -> list[tuple]:
        return [
            (self.outcome, t, float(b), float(s), float(b / s), float(p), self.n)
            for t, b, s, p in zip(self.terms, self.coef, self.std_error, self.p_values())
        ]

    def __getitem__(self, term: str) -> float:
        return float(self.coef[self.terms.index(term)])


def independent_columns(gram: np.ndarray, tolerance: float = PIVOT_TOLERANCE) -> list[int]:
    """Columns, in order, that are not linear combinations of earlier ones (Cholesky with dropping)."""
    kept: list[int] = []
    factor = np.zeros((0, 0))
    for j in range(gram.shape[0]):
        if gram[j, j] <= 0:
            continue
        cross = gram[np.ix_(kept, [j])][:, 0]
        row = np.linalg.solve(factor, cross) if kept else np.zeros(0)
        left = gram[j, j] - row @ row
        if left > tolerance * gram[j, j]:
            grown = np.zeros((len(kept) + 1, len(kept) + 1))
            grown[:-1, :-1] = factor
            grown[-1, :-1] = row
            grown[-1, -1] = math.sqrt(left)
            factor, kept = grown, [*kept, j]
    return kept


@dataclass(frozen=True)
class Layout:
    """Names and scales of one model's columns. ``columns`` are those of the products, in order; ``one`` is the constant."""

    outcome: str
    terms: tuple[str, ...]
    y: str
    regressors: tuple[str, ...]
    columns: tuple[str, ...]
    center: Mapping[str, float]
    scale: Mapping[str, float]
    swept: bool
    factors: tuple[str, ...] = ()
    nested: frozenset[str] = frozenset()

    def product(self, a: str, b: str) -> str:
        first, second = sorted((a, b), key=self.columns.index)
        return f"p_{first}_{second}"

    def term(self, short: str) -> str:
        return "(Intercept)" if short == "one" else dict(zip((r for r in self.regressors if r != "one"), self.terms))[short]


@dataclass
class Solution:
    """Coefficients in scaled units for the regressors in use (their places), the inverse of X'X, and the residual sum of squares."""

    used: list[int]
    b: np.ndarray
    bread: np.ndarray
    rss: float

    def padded(self, size: int) -> list[float]:
        """The coefficients of all regressors; those out of use have 0."""
        whole = np.zeros(size)
        whole[self.used] = self.b
        return whole.tolist()


def solved(total: Mapping, layout: Layout) -> Solution:
    """Coefficients from the sums of products. Regressors without spread of their own, or spanned by earlier ones, are left out."""

    def products(names: Sequence[str], others: Sequence[str]) -> np.ndarray:
        return np.array([[float(total[layout.product(a, b)]) for b in others] for a in names]).reshape(len(names), len(others))

    regressors, y = layout.regressors, layout.y
    gram = products(regressors, regressors)
    # A column that the factors or the scaling left without spread is no regressor. Judge it on its scale.
    for j, a in enumerate(regressors):
        if a != "one" and gram[j, j] <= PIVOT_TOLERANCE * max(float(total[f"raw_{a}"]), 1e-300):
            gram[j, j] = 0.0
    used = independent_columns(gram)
    names = [regressors[j] for j in used]
    xx, xy = products(names, names), products(names, [y])[:, 0]
    bread = np.linalg.inv(xx)
    b = bread @ xy
    return Solution(used, b, bread, max(float(products([y], [y])[0, 0]) - 2.0 * b @ xy + b @ xx @ b, 0.0))


def finished(total: Mapping, layout: Layout, solution: Solution, vcov: str, meat: np.ndarray | None, groups: int | None) -> Fit:
    """Standard errors, original units and fit statistics. ``meat`` has all regressors' rows, also those out of use.

    Absorbed levels count as parameters, less those that depend on others (``dependent``). With clusters, a factor nested in
    them counts once.
    """
    n = int(total["n"])
    used = [layout.regressors[j] for j in solution.used]
    sizes = {f: int(total[f"l_{f}"]) for f in layout.factors}
    n_params = len(used) + (sum(sizes.values()) - int(total["dependent"]) if sizes else 0)
    degrees = n - n_params
    bread = solution.bread
    if meat is not None:
        meat = meat[np.ix_(solution.used, solution.used)]
    if vcov == "iid":
        v, df_t = bread * (solution.rss / degrees if degrees > 0 else math.nan), degrees
    elif vcov == "hc1":
        v, df_t = bread @ meat @ bread * (n / degrees if degrees > 0 else math.nan), degrees
    else:
        counted = n_params - sum(size - 1 for f, size in sizes.items() if f in layout.nested)
        c = (groups / (groups - 1)) * ((n - 1) / (n - counted)) if groups > 1 and n > counted else math.nan
        v, df_t = bread @ meat @ bread * c, groups - 1

    y_scale, y_center = layout.scale[layout.outcome], layout.center[layout.outcome]
    back, shift = np.zeros((len(used), len(used))), np.zeros(len(used))
    for j, a in enumerate(used):
        if a == "one":
            back[j, j], shift[j] = y_scale, y_center
        else:
            back[j, j] = y_scale / layout.scale[layout.term(a)]
    if "one" in used:
        at = used.index("one")
        for j, a in enumerate(used):
            if a != "one":
                back[at, j] = -y_scale * layout.center[layout.term(a)] / layout.scale[layout.term(a)]

    unit = y_scale * y_scale
    rss, within = solution.rss, float(total[layout.product(layout.y, layout.y)])
    tss = max(float(total[f"raw_{layout.y}"]) - float(total[f"s_{layout.y}"]) ** 2 / n, 0.0)
    loglik = -0.5 * n * (math.log(2 * math.pi) + math.log(max(rss * unit, 1e-300) / n) + 1)
    stats = {
        "n": n,
        "r2": 1 - rss / tss if tss > 0 else math.nan,
        "adj_r2": 1 - (rss / degrees) / (tss / (n - 1)) if tss > 0 and degrees > 0 else math.nan,
        "within_r2": 1 - rss / within if layout.swept and within > 0 else math.nan,
        "rmse": math.sqrt(rss * unit / n),
        "loglik": loglik,
        "aic": -2 * loglik + 2 * n_params,
        "bic": -2 * loglik + math.log(n) * n_params,
    }
    labels = [layout.term(a) for a in used]
    return Fit(
        outcome=layout.outcome,
        terms=labels,
        coef=back @ solution.b + shift,
        vcov=back @ v @ back.T,
        n=n,
        n_params=n_params,
        df_t=df_t,
        vcov_type=vcov,
        stats=stats,
        dropped=[t for t in layout.terms if t not in labels],
    )


def outer_names(size: int, tag: str = "m") -> list[str]:
    return [f"{tag}_{i}_{j}" for i in range(size) for j in range(i, size)]


def read_outer(row: Mapping, size: int, tag: str = "m") -> np.ndarray:
    out = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            out[i, j] = out[j, i] = float(row[f"{tag}_{i}_{j}"] or 0.0)
    return out


# Batches: sums of many segments come as arrays in the order of ``fields``, and go back as rows with arrays.


def solve_batches(fields: Sequence[str], layouts: Mapping[str, Layout]):
    """For every segment (``_s``) and model its coefficients, in scaled units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"_s": [], "_model": [], "_b": []}
            for s, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total = dict(zip(fields, numbers))
                for name, layout in layouts.items():
                    out["_s"].append(s)
                    out["_model"].append(name)
                    out["_b"].append(solved(total, layout).padded(len(layout.regressors)))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("_s", pa.int64()), ("_model", pa.string()), ("_b", pa.list_(pa.float64()))]))

    return run


FIT_FIELDS = (
    "fit string, outcome string, terms array<string>, coef array<double>, std_error array<double>, statistic array<double>, p_value array<double>, "
    "vcov array<double>, n bigint, n_params bigint, df_t double, dropped array<string>, stat_names array<string>, stat_values array<double>"
)


def finish_batches(fields: Sequence[str], layouts: Mapping[str, Layout], vcov: str):
    """For every segment (``_s``) and model the whole fit, with errors of the kind asked for."""
    types = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()), "bigint": pa.int64(), "double": pa.float64()}
    names = [part.split(" ") for part in FIT_FIELDS.split(", ")]
    schema = pa.schema([("_s", pa.int64()), *[(n, types[t]) for n, t in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for s, numbers, model, meat, groups in zip(*[c.to_pylist() for c in batch.columns]):
                total = dict(zip(fields, numbers))
                for name, layout in layouts.items():
                    if model not in (None, name):
                        continue
                    size = len(layout.regressors)
                    middle = read_outer(dict(zip(outer_names(size), meat)), size) if meat is not None else None
                    fit = finished(total, layout, solved(total, layout), vcov, middle, groups)
                    errors = fit.std_error
                    with np.errstate(all="ignore"):
                        ratios = (fit.coef / errors).tolist()
                    out.append(
                        (s, name, fit.outcome, fit.terms, fit.coef.tolist(), errors.tolist(), ratios, fit.p_values(), fit.vcov.reshape(-1).tolist(), fit.n)
                        + (fit.n_params, float(fit.df_t), fit.dropped, list(fit.stats), [float(v) for v in fit.stats.values()])
                    )
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    return run
