"""Fixed-effects regression as Spark aggregates; only k x k matrices reach the driver."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import SAMPLES, flag, log_positive, scrub
from .io import stable
from .panel import BROADCAST_GROUPS, with_means


#: Values among which an exact quantile is looked up in one task at most; beyond it a band around it is cut out first.
QUANTILE_ROWS = 1_000_000


def quantiles(df: DataFrame, column: str, at: Sequence[float], most: int = QUANTILE_ROWS) -> list[float | None]:
    """Exact quantiles with linear interpolation.

    Of more than ``most`` values each quantile is first enclosed between approximate ones; one pass counts what lies
    below and between, and only the values between are looked at further.
    """
    df = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    n = df.count()
    if n <= most:
        return list(df.agg(F.percentile("x", list(at))).first()[0] or [None] * len(at))
    bounds = sorted({min(1.0, max(0.0, q + d)) for q in at for d in (-0.0005, 0.0005)})
    values = dict(zip(bounds, df.agg(F.percentile_approx("x", bounds, 10_000)).first()[0], strict=True))
    least, greatest = df.agg(F.min("x"), F.max("x")).first()
    ends = [(least if q <= 0.0005 else values[q - 0.0005], greatest if q >= 0.9995 else values[q + 0.0005]) for q in at]
    row = df.agg(*(c for lo, hi in ends for c in (F.count_if(F.col("x") < lo), F.count_if(F.col("x").between(lo, hi))))).first()
    out: list[float | None] = []
    for i, (q, (lo, hi)) in enumerate(zip(at, ends, strict=True)):
        below, inside = row[2 * i], row[2 * i + 1]
        rank = (q * (n - 1) - below) / max(1, inside - 1)
        if lo == hi:
            out.append(lo)
        elif inside == n or not 0 <= rank <= 1:
            out.append(df.agg(F.percentile("x", q)).first()[0])
        else:
            out += quantiles(df.where(F.col("x").between(lo, hi)), "x", [rank], most)
    return out


def winsorise(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip at exact, linearly interpolated quantiles."""
    lo, hi = quantiles(df, column, [low, high])
    return df if lo is None else df.withColumn(column, F.least(F.greatest(F.col(column), F.lit(lo)), F.lit(hi)))


def standardise(df: DataFrame, column: str) -> DataFrame:
    """Zero mean, unit sample SD; 0 where the SD is 0."""
    s = df.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    z = F.when(F.col("__s") > 0, (F.col(column) - F.col("__m")) / F.col("__s")).otherwise(F.lit(0.0))
    return df.crossJoin(F.broadcast(s)).withColumn(column, z).drop("__m", "__s")


def demean(df: DataFrame, columns: Sequence[str], by: Sequence[str], small: bool | None = None) -> DataFrame:
    """Columns less their group means; see ``panel.with_means``."""
    out = with_means(df, by, {f"__m_{c}": F.avg(c) for c in columns}, small)
    return out.withColumns({c: F.col(c) - F.col(f"__m_{c}") for c in columns}).drop(*(f"__m_{c}" for c in columns))


def n_groups(df: DataFrame, by: Sequence[str]) -> int:
    return df.select(*by).distinct().count()


def residualise(df: DataFrame, columns: Sequence[str], fe1: Sequence[str], fe2: Sequence[str], max_rounds: int = 30, tol: float = 1e-8, every: int = 5) -> DataFrame:
    """Two-way within transform: demean by ``fe1`` then ``fe2`` until the root mean squares stand still.

    Rows are first summed to cells of both effects, which carry all that the demeaning needs. A round takes each
    effect in turn as the group means of the cells less the other effect, two joins of the cells with a table of
    effects. Each ``every`` rounds and after the last the effects are computed once (``io.stable``), which cuts the plan,
    and the stop test runs: no root mean square of the rows has moved by ``tol`` since the test before; 1e-12 of its
    own size counts as rounding. Raises ``RuntimeError`` where ``max_rounds`` rounds do not reach ``tol``.
    """
    keys = list(dict.fromkeys([*fe1, *fe2]))
    sums = [x for c in columns for x in (F.avg(c).alias(f"__0_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"__q_{c}"))]
    cells = stable(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *sums))
    few = {side: n_groups(cells, by) <= BROADCAST_GROUPS for side, by in (("a", fe1), ("b", fe2))}
    n = cells.agg(F.sum("__n")).first()[0] or 0

    def less(rows: DataFrame, side: str, effects: DataFrame | None) -> DataFrame:
        """Rows with the effects of one side as ``__<side>_<column>``; 0 before there are any."""
        if effects is None:
            return rows.withColumns({f"__{side}_{c}": F.lit(0.0) for c in columns})
        on = [F.col(k).eqNullSafe(F.col(f"__{side}k_{k}")) for k in (fe1 if side == "a" else fe2)]
        out = rows.join(F.broadcast(effects) if few[side] else effects, on)
        return out.drop(*(c for c in effects.columns if c.startswith(f"__{side}k_")))

    def means(rows: DataFrame, side: str, other: str) -> DataFrame:
        by = [F.col(k).alias(f"__{side}k_{k}") for k in (fe1 if side == "a" else fe2)]
        mean = lambda c: F.try_divide(F.sum(F.col("__n") * (F.col(f"__0_{c}") - F.col(f"__{other}_{c}"))), F.sum("__n"))
        return rows.groupBy(*by).agg(*(mean(c).alias(f"__{side}_{c}") for c in columns))

    a = b = before = None
    moved = math.inf
    for i in range(1, max_rounds + 1):
        a = means(less(cells, "b", b), "a", "b")
        b = means(less(cells, "a", a), "b", "a")
        if i % every and i < max_rounds:
            continue
        a, b = stable(a), stable(b)
        left = lambda c: F.col(f"__0_{c}") - F.col(f"__a_{c}") - F.col(f"__b_{c}")
        squares = (F.sum(F.col(f"__q_{c}") + F.col("__n") * (left(c) * left(c) - F.col(f"__0_{c}") * F.col(f"__0_{c}"))) for c in columns)
        now = [None if s is None else math.sqrt(max(0.0, s / n)) for s in less(less(cells, "a", a), "b", b).agg(*squares).first()]
        if before is not None:
            moved = max((d for x, y in zip(now, before, strict=True) if x is not None and (d := abs(x - y)) > 1e-12 * x), default=0.0)
            if moved < tol:
                out = less(less(df, "a", a), "b", b)
                return out.select(*((F.col(c) - F.col(f"__a_{c}") - F.col(f"__b_{c}")).alias(c) if c in columns else c for c in df.columns))
        before = now
    raise RuntimeError(f"two-way demeaning moved by {moved:.2e} in its last rounds, over {tol:.2e} after {max_rounds}")


def residualise_fast(df: DataFrame, columns: Sequence[str], fe1: Sequence[str], fe2: Sequence[str], max_rounds: int = 30, tol: float = 1e-8) -> DataFrame:
    """Two-way within transform by conjugate gradients: what ``residualise`` tends to, in far fewer rounds where effects hang together loosely.

    The first effects are eliminated, which leaves equations in the others, the fewer ones; each round is two joins of the
    cells with a table of effects, one written table and one row of sums at the driver, all columns at once, scaled by
    group sizes. In exact arithmetic it ends after as many rounds as there are groups of the fewer side. It stops when the root mean square of
    the group means that are left is under ``tol`` of the column's own; raises ``RuntimeError`` where ``max_rounds`` do not reach that.
    """
    keys = list(dict.fromkeys([*fe1, *fe2]))
    sums = [x for c in columns for x in (F.avg(c).alias(f"__0_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"__q_{c}"))]
    cells = stable(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *sums))
    one, two = (fe1, fe2) if n_groups(cells, fe1) >= n_groups(cells, fe2) else (fe2, fe1)
    total = cells.agg(F.sum("__n"), *(F.sum(f"__q_{c}") for c in columns)).first()
    n = total[0] or 0
    size = {c: math.sqrt((q or 0.0) / max(1, n)) or 1.0 for c, q in zip(columns, total[1:], strict=True)}

    def to(rows: DataFrame, by: Sequence[str], effects: DataFrame) -> DataFrame:
        named = effects.withColumnsRenamed({k: f"__k_{k}" for k in by})
        return rows.join(named, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by]).drop(*(f"__k_{k}" for k in by))

    def over(by: Sequence[str], rows: DataFrame, value, mean: bool) -> DataFrame:
        """Sums, or means, over groups of ``value(column)``, weighted by the cells' sizes."""
        part = lambda c: F.sum(F.col("__n") * value(c))
        return rows.groupBy(*by).agg(*((F.try_divide(part(c), F.sum("__n")) if mean else part(c)).alias(f"__v_{c}") for c in columns))

    def eliminated(rows: DataFrame, value) -> DataFrame:
        """Sums over the second effects of ``value`` less its mean over the first ones."""
        means = over(one, rows, value, True).withColumnsRenamed({f"__v_{c}": f"__m_{c}" for c in columns})
        return over(two, to(rows, one, means), lambda c: value(c) - F.col(f"__m_{c}"), False)

    start = eliminated(cells, lambda c: F.col(f"__0_{c}")).withColumnsRenamed({f"__v_{c}": f"__r_{c}" for c in columns})
    groups = cells.groupBy(*two).agg(F.sum("__n").alias("__n2"))
    state = to(groups, two, start).withColumns({k: v for c in columns for k, v in ((f"__x_{c}", F.lit(0.0)), (f"__p_{c}", F.col(f"__r_{c}") / F.col("__n2")))})
    for i in range(max_rounds + 1):
        state = stable(state)
        along = state.select(*two, *(F.col(f"__p_{c}") for c in columns))
        state = stable(to(state, two, eliminated(to(cells, two, along), lambda c: F.col(f"__p_{c}"))))
        parts = [x for c in columns for x in (F.sum(F.col(f"__p_{c}") * F.col(f"__v_{c}")), *(F.sum(F.col(f"__{a}_{c}") * F.col(f"__{b}_{c}") / F.col("__n2")) for a, b in ("rr", "rv", "vv")))]
        found = [float(v or 0.0) for v in state.agg(*parts).first()]
        left, step, turn = {}, {}, {}
        for k, c in enumerate(columns):
            pv, rr, rv, vv = found[4 * k : 4 * k + 4]
            left[c] = math.sqrt(max(0.0, rr) / max(1, n)) / size[c]
            step[c] = rr / pv if pv > 0 else 0.0
            turn[c] = max(0.0, rr - 2 * step[c] * rv + step[c] ** 2 * vv) / rr if rr > 0 else 0.0
        worst = max(left.values(), default=0.0)
        if worst < tol:
            b = state.select(*two, *(F.col(f"__x_{c}").alias(f"__b_{c}") for c in columns))
            a = over(one, to(cells, two, b), lambda c: F.col(f"__0_{c}") - F.col(f"__b_{c}"), True).withColumnsRenamed({f"__v_{c}": f"__a_{c}" for c in columns})
            out = to(to(df, two, b), one, stable(a))
            return out.select(*((F.col(c) - F.col(f"__a_{c}") - F.col(f"__b_{c}")).alias(c) if c in columns else c for c in df.columns))
        nxt = {f"__x_{c}": F.col(f"__x_{c}") + F.lit(step[c]) * F.col(f"__p_{c}") for c in columns}
        r = {c: F.col(f"__r_{c}") - F.lit(step[c]) * F.col(f"__v_{c}") for c in columns}
        nxt |= {f"__r_{c}": r[c] for c in columns} | {f"__p_{c}": r[c] / F.col("__n2") + F.lit(turn[c]) * F.col(f"__p_{c}") for c in columns}
        state = state.select(*two, "__n2", *(v.alias(k) for k, v in nxt.items()))
    raise RuntimeError(f"two-way demeaning has group means of {worst:.2e} left, over {tol:.2e} after {max_rounds} rounds")


def without_singletons(df: DataFrame, fe1: Sequence[str], fe2: Sequence[str]) -> DataFrame:
    """``df`` less rows that are alone in a group of either effect, again until there are none: such rows fit exactly."""
    before = df.count()
    while True:
        for by in (fe1, fe2):
            n = df.groupBy(*(F.col(k).alias(f"__k_{k}") for k in by)).agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1").drop("__rows")
            df = df.join(n, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by], "left_semi")
        df = stable(df)
        now = df.count()
        if now == before:
            return df
        before = now


def connected_sets(df: DataFrame, fe1: Sequence[str], fe2: Sequence[str]) -> DataFrame:
    """``fe2, component``: groups of the second effects that are linked through the first ones have one component.

    Least labels go to and fro over the cells of both effects, and each label is replaced by its own label, so that long chains
    take few rounds. The effects' degrees of freedom are both numbers of groups less the number of components.
    """
    cells = stable(df.select(F.xxhash64(*fe1, F.lit(1)).alias("a"), F.xxhash64(*fe2, F.lit(2)).alias("b")).distinct())
    labels, seen = stable(cells.select("b", F.col("b").alias("component")).distinct()), None
    while True:
        low = cells.join(labels, "b").groupBy("a").agg(F.min("component").alias("component"))
        low = cells.join(low, "a").groupBy("b").agg(F.min("component").alias("component"))
        jump = labels.select(F.col("b").alias("component"), F.col("component").alias("next"))
        labels = stable(low.join(jump, "component", "left").select("b", F.least("component", "next").alias("component")))
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == seen:
            break
        seen = now
    ids = df.select(*fe2, F.xxhash64(*fe2, F.lit(2)).alias("b")).distinct()
    return ids.join(labels, "b").drop("b")


def effect_degrees(df: DataFrame, fe1: Sequence[str], fe2: Sequence[str]) -> int:
    """Degrees of freedom that both effects use up: groups of either, less one for each connected set."""
    return n_groups(df, fe1) + n_groups(df, fe2) - connected_sets(df, fe1, fe2).select("component").distinct().count()


def slice_conditions(treatment: str, index: str = "composite", sample: str = "baseline") -> dict[str, Column]:
    """What a robustness grid's rows meet in each of four views: ``main``, ``indices`` (all of the plain baseline), ``samples`` and ``winsorised`` of one index."""
    own, plain, base = F.col("index_name") == index, F.col("winsorised") == "0", F.col("sample") == sample
    effect = F.col("term") == F.concat(F.lit(f"{treatment}_x_"), "index_name")
    return {"main": effect & own & base & plain, "indices": effect & base & plain, "samples": effect & own & plain, "winsorised": effect & own & base & (F.col("winsorised") == "1")}


def result_slices(results: DataFrame, treatment: str, index: str = "composite", sample: str = "baseline") -> dict[str, DataFrame]:
    """The views of ``slice_conditions``, each a table."""
    return {name: results.where(c) for name, c in slice_conditions(treatment, index, sample).items()}


@dataclass(frozen=True)
class Model:
    """One least-squares fit: outcome, regressors, whether it has a constant, absorbed dummies, the outcome before demeaning.

    ``scale`` multiplies a regressor, as standardising does; ``names`` gives terms other names than their columns.
    """

    y: str
    x: Sequence[str]
    constant: bool = True
    extra_k: int = 0
    raw_y: str | None = None
    scale: Mapping[str, float] = field(default_factory=dict)
    names: Mapping[str, str] = field(default_factory=dict)


def fit_models(df: DataFrame, models: Sequence[Model], cluster: str) -> list[list[dict]]:
    """Several ``cluster_ols`` over the same complete rows: one aggregate for all X'X and X'y, one for all clusters' scores, one for their products.

    ``df`` is read twice and should be a written table of doubles.
    """
    cell = lambda a, b: F.sum(_col(a) * _col(b))
    jobs, parts = [], [F.count(F.lit(1))]

    def ask(c) -> int:
        parts.append(c)
        return len(parts) - 1

    for m in models:
        terms, raw = ["__one"] * m.constant + list(m.x), m.raw_y or m.y
        pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
        jobs.append({
            "terms": terms, "pairs": pairs, "raw": [ask(c) for c in (F.avg(raw), F.stddev_samp(raw), F.sum(F.col(raw) * F.col(raw)))],
            "spread": {t: (ask(F.stddev_pop(t)), ask(F.max(F.abs(F.col(t))))) for t in m.x}, "xx": [ask(cell(terms[i], terms[j])) for i, j in pairs], "xy": [ask(cell(t, m.y)) for t in terms],
        })
    got = df.agg(*(c.alias(f"c{i}") for i, c in enumerate(parts))).first()
    n, sums, rows = got[0], [], {}
    for k, (m, job) in enumerate(zip(models, jobs, strict=True)):
        own = [i for i, t in enumerate(job["terms"]) if t == "__one" or got[job["spread"][t][0]] and got[job["spread"][t][0]] > 1e-10 * got[job["spread"][t][1]]]
        xx = np.zeros((len(job["terms"]),) * 2)
        for (i, j), at in zip(job["pairs"], job["xx"], strict=True):
            xx[i, j] = xx[j, i] = got[at] or 0.0
        job["own"], job["inverse"] = own, np.linalg.pinv(xx[np.ix_(own, own)]) if own else np.zeros((0, 0))
        job["beta"] = job["inverse"] @ np.array([got[job["xy"][i]] or 0.0 for i in own])
        if not n or not own:
            continue
        u = F.col(m.y) - sum((F.lit(float(v)) * _col(job["terms"][i]) for v, i in zip(job["beta"], own, strict=True)), F.lit(0.0))
        rows |= {f"__u{k}": u}
        sums += [F.sum(_col(job["terms"][i]) * F.col(f"__u{k}")).alias(f"__s{k}_{i}") for i in own] + [F.sum(F.col(f"__u{k}") * F.col(f"__u{k}")).alias(f"__e{k}")]
    meats = None
    if sums:
        scores = df.withColumns(rows).groupBy(cluster).agg(*sums)
        products = [F.sum(F.col(f"__s{k}_{i}") * F.col(f"__s{k}_{j}")).alias(f"m{k}_{i}_{j}") for k, job in enumerate(jobs) for i in job["own"] for j in job["own"] if i <= j and f"__u{k}" in rows]
        meats = scores.agg(F.count(F.lit(1)).alias("g"), *products, *(F.sum(f"__e{k}").alias(f"e{k}") for k in range(len(models)) if f"__u{k}" in rows)).first()
    return [_estimates(m, job, n, got, meats, k) for k, (m, job) in enumerate(zip(models, jobs, strict=True))]


def _col(term: str) -> Column:
    return F.lit(1.0) if term == "__one" else F.col(term)


def _estimates(m: Model, job: dict, n: int, got, meats, k: int) -> list[dict]:
    """A row for each term of one model from the sums of ``fit_models``."""
    own, terms, inverse = job["own"], job["terms"], job["inverse"]
    mean, sd, square = (got[i] for i in job["raw"])
    blank = {"coef": None, "se": None, "p": None, "low": None, "high": None, "n": n, "clusters": None, "r2": None, "y_mean": mean, "y_sd": sd}
    found = {}
    if n and own:
        meat = np.array([[meats[f"m{k}_{min(i, j)}_{max(i, j)}"] for j in own] for i in own])
        g, rss, dof = meats["g"], meats[f"e{k}"], n - len(m.x) - m.constant - m.extra_k
        factor = g / (g - 1) * (n - 1) / dof if g > 1 and dof > 0 else float("nan")
        se = np.sqrt(np.maximum(np.diag(factor * inverse @ meat @ inverse), 0))
        tss = (sd or 0.0) ** 2 * (n - 1) if m.constant or m.raw_y else square
        r2 = 1 - rss / tss if tss else None
        for i, b, e in zip(own, map(float, job["beta"]), map(float, se), strict=True):
            unit = m.scale.get(terms[i], 1.0)
            b, e = b * unit, e * unit
            p = math.erfc(abs(b / e) / math.sqrt(2)) if e > 0 else None
            found[i] = {"coef": b, "se": e, "p": p, "low": b - 1.96 * e, "high": b + 1.96 * e, "n": n, "clusters": g, "r2": r2, "y_mean": mean, "y_sd": sd}
        blank |= {"clusters": g, "r2": r2}
    return [{"term": "const" if t == "__one" else m.names.get(t, t), **found.get(i, blank)} for i, t in enumerate(terms)]


def cluster_ols(df: DataFrame, y: str, x: Sequence[str], cluster: str, constant: bool = True, extra_k: int = 0, raw_y: str | None = None) -> list[dict]:
    """OLS with cluster-robust (CR1) errors: one aggregate for X'X and X'y, one for the clusters' scores.

    Rows with a null, NaN or infinite value in a regressor or ``y`` are left out. A regressor without variance gets null
    estimates and counts in k all the same. ``extra_k`` counts absorbed dummies; R2 is of ``raw_y``, the outcome before
    demeaning, where it is given. A row for each term: coef, se, p, bounds, n, clusters, r2, y_mean, y_sd.
    """
    raw = raw_y or y
    df = scrub(df.select(cluster, *(F.col(c).cast("double").alias(c) for c in dict.fromkeys([*x, y, raw]))), [*x, y])
    return fit_models(stable(df), [Model(y, x, constant, extra_k, raw_y)], cluster)[0]


def fe_ols_specs(df: DataFrame, y: str, x: Sequence[str], cluster: str, fe: Sequence[str], specs: Mapping[str, tuple[bool, bool, bool]]) -> dict[str, list[dict]]:
    """Several specifications of ``fe_ols`` over the same rows: a name and whether it has fixed effects, unit-variance regressors, a winsorised outcome.

    Rows are scrubbed, clipped and demeaned once, in one written table; standardising only scales what is estimated.
    """
    df = scrub(df.select(*dict.fromkeys([cluster, *fe]), *(F.col(c).cast("double").alias(c) for c in [y, *x])), [y, *x])
    own = [y]
    if any(win for *_, win in specs.values()):
        df = stable(df)
        lo, hi = quantiles(df, y, [0.01, 0.99])
        df, own = df.withColumn("__win", F.least(F.greatest(F.col(y), F.lit(lo)), F.lit(hi)) if lo is not None else F.col(y)), [y, "__win"]
    groups = 0
    if any(has for has, *_ in specs.values()):
        groups = n_groups(df, fe)
        df = with_means(df, fe, {f"__m_{c}": F.avg(c) for c in [*own, *x]}, groups <= BROADCAST_GROUPS)
        df = df.withColumns({f"__d_{c}": F.col(c) - F.col(f"__m_{c}") for c in [*own, *x]})
    df = stable(df)
    sds = dict(zip(x, df.agg(*(F.stddev_samp(c) for c in x)).first(), strict=True))
    models = []
    for has, std, win in specs.values():
        out, at = "__win" if win else y, "__d_" if has else ""
        scale = {at + c: sds[c] for c in x if std and sds[c]}
        models.append(Model(at + out, [at + c for c in x], not has, groups if has else 0, out if has else None, scale, {at + c: c for c in x}))
    return {name: [r for r in rows if r["term"] != "const"] for name, rows in zip(specs, fit_models(df, models, cluster), strict=True)}


def fe_ols(df: DataFrame, y: str, x: Sequence[str], cluster: str, fe: Sequence[str] = (), standardised: bool = False, winsorised: bool = False) -> list[dict]:
    """OLS with or without one-way fixed effects, by exact demeaning; k counts the effects' dummies.

    ``standardised`` regressors get unit sample SD over the rows used, ``winsorised`` clips the outcome first.
    """
    return fe_ols_specs(df, y, x, cluster, fe, {"": (bool(fe), standardised, winsorised)})[""]


def result_table(spark, rows: list[dict]) -> DataFrame:
    """Coefficients with their 95 % bounds and the model's diagnostics, sorted by term; labels before ``term`` stay."""
    kinds = {"n": "long", "clusters": "long"} | dict.fromkeys(("coef", "se", "p", "low", "high", "r2", "y_mean", "y_sd"), "double")
    names = list(rows[0]) if rows else ["term", *kinds]
    values = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r.values()) for r in rows]
    return spark.createDataFrame(values, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in names)).orderBy(*[c for c in names if c not in kinds])


def interacted(df: DataFrame, treatment: str, index: str, out: str, level: str | None = None, log_level: bool = False) -> DataFrame:
    """Add the product of a treatment and an index and, as ``level_control``, the outcome's level or its log where positive."""
    df = df.withColumn(out, F.col(treatment) * F.col(index))
    if level:
        df = df.withColumn("level_control", log_positive(F.col(level)) if log_level else F.col(level).cast("double"))
    return df


def diagnostics(rows: list[dict], labels: Sequence[str]) -> list[dict]:
    """One row a model: its labels, n, clusters, R2, mean and SD of the outcome."""
    kept = [*labels, "n", "clusters", "r2", "y_mean", "y_sd"]
    return list({tuple(r[c] for c in labels): {c: r[c] for c in kept} for r in rows}.values())


def robustness_grid(df: DataFrame, outcomes: Sequence[str], treatment: str, indices: Sequence[str], controls: Sequence[str], fe1: Sequence[str], fe2: Sequence[str], cluster: str, samples: Sequence[str] = tuple(SAMPLES)) -> list[dict]:
    """Two-way fixed-effects estimates of treatment x index over samples, outcomes, indices and plain or winsorised outcomes.

    All samples of an outcome and index are demeaned together, with effects of their own; a row counts in each sample
    that it is in.
    """
    rows: list[dict] = []
    conditions = F.array(*(F.when(F.expr(SAMPLES[s]), F.lit(s)) for s in samples))
    df = stable(df.withColumn("__sample", F.explode(F.array_compact(conditions))))
    for y in outcomes:
        for index in indices:
            own = interacted(df, treatment, index, "__treat")
            own = own.select(*dict.fromkeys(["__sample", cluster, *fe1, *fe2]), *(F.col(c).cast("double").alias(c) for c in [y, "__treat", *controls]))
            own = stable(scrub(own, [y, "__treat", *controls]))
            there = [r[0] for r in own.select("__sample").distinct().collect()]  # at most the named samples
            clipped = F.col(y)
            for s in there:
                lo, hi = quantiles(own.where(F.col("__sample") == s), y, [0.01, 0.99])
                clipped = F.when(F.col("__sample") == s, F.least(F.greatest(F.col(y), F.lit(lo)), F.lit(hi))).otherwise(clipped)
            own = own.withColumn("__win", clipped)
            within = stable(residualise_fast(own, [y, "__win", "__treat", *controls], ["__sample", *fe1], ["__sample", *fe2]))
            for s in (s for s in samples if s in there):
                for win, out in enumerate((y, "__win")):
                    for r in cluster_ols(within.where(F.col("__sample") == s), out, ["__treat", *controls], cluster, constant=False):
                        term = f"{treatment}_x_{index}" if r["term"] == "__treat" else r["term"]
                        rows.append({"sample": s, "outcome": y, "index_name": index, "winsorised": str(win), **r, "term": term})
    return rows


def binscatter(df: DataFrame, x: str, y: str, bins: int = 20, controls: Sequence[str] = (), fe: Sequence[str] = ()) -> DataFrame:
    """Means of x and y in quantile bins of x; equal edges fall together. ``slope`` and ``intercept`` go through the bins' means.

    With ``controls`` or ``fe`` both are first replaced by what these do not explain.
    """
    if controls or fe:
        df = stable(residuals(df, [x, y], controls, fe))
    edges = sorted({e for e in quantiles(df, x, [i / bins for i in range(bins + 1)]) if e is not None})
    b = F.greatest(F.size(F.filter(F.lit(edges), lambda e: e < F.col(x))), F.lit(1)) if edges else F.lit(1)
    means = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(b.alias("bin")).agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.count(F.lit(1)).alias("n"))
    line = means.agg(F.regr_slope("mean_y", "mean_x").alias("slope"), F.regr_intercept("mean_y", "mean_x").alias("intercept"))
    return means.crossJoin(F.broadcast(line))


def residuals(df: DataFrame, columns: Sequence[str], controls: Sequence[str], fe: Sequence[str] = ()) -> DataFrame:
    """``columns`` less what controls, a constant and fixed effects explain (Frisch-Waugh-Lovell); incomplete rows go."""
    names = [*columns, *controls]
    df = scrub(df.select(*fe, *(F.col(c).cast("double").alias(c) for c in names)), names)
    df = demean(df, names, fe, None) if fe else demean(df.withColumn("__all", F.lit(1)), names, ["__all"], True)
    if not controls:
        return df
    df, k = stable(df), len(controls)
    cell = lambda a, b: F.sum(F.col(a) * F.col(b))
    s = df.agg(*(cell(a, b) for a in controls for b in controls), *(cell(a, y) for y in columns for a in controls)).first()
    inverse = np.linalg.pinv(np.array(s[: k * k], float).reshape(k, k))
    out = {}
    for i, y in enumerate(columns):
        beta = inverse @ np.array(s[k * k + i * k : k * k + (i + 1) * k], float)
        out[y] = F.col(y) - sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, controls, strict=True)), F.lit(0.0))
    return df.withColumns(out)


def visibility_index(df: DataFrame, occupation: str, groups: dict[str, Sequence[str]], year: str, first: int, last: int) -> DataFrame:
    """``occupation, visibility_<group>, top_decile_<group>``: means in a window of years, as z-scores over occupations, averaged.

    Missing z-scores are passed over; the top decile is from the exact 0.9 quantile on.
    """
    columns = list(dict.fromkeys(c for g in groups.values() for c in g))
    means = df.where(F.col(year).between(first, last)).groupBy(occupation).agg(*(F.avg(c).alias(c) for c in columns))
    for c in columns:
        means = standardise(means, c)
    out = means.withColumns({f"visibility_{g}": F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in own), F.lit(0.0)), sum((F.col(c).isNotNull().cast("int") for c in own), F.lit(0))) for g, own in groups.items()})
    out = stable(out.select(occupation, *(f"visibility_{g}" for g in groups)))
    tops = {g: quantiles(out, f"visibility_{g}", [0.9])[0] for g in groups}
    return out.withColumns({f"top_decile_{g}": flag(F.col(f"visibility_{g}") >= F.lit(q)) for g, q in tops.items()})


def event_path(df: DataFrame, time: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, SD, n and 95 % bounds of y at each event time (and group)."""
    out = df.where(F.col(time).isNotNull() & F.col(y).isNotNull()).groupBy(time, *by).agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"), F.count(F.lit(1)).alias("n"))
    se = F.col("sd") / F.sqrt("n")
    return out.withColumns({"se": se, "low": F.col("mean") - 1.96 * se, "high": F.col("mean") + 1.96 * se})


def event_path_by_split(df: DataFrame, time: str, y: str, index: str, window: int) -> DataFrame:
    """Event path within ``window`` of the event, apart for rows at or over the median of ``index`` and under it."""
    own = stable(df.where(F.col(time).between(-window, window) & F.col(y).isNotNull()))
    median = quantiles(own, index, [0.5])[0]
    half = F.when(F.col(index) >= F.lit(median), "high").otherwise("low")
    return event_path(own.withColumn("half", half), time, y, ["half"])
