"""Spells, weighted panels, first events, selection and dynamics over entity x time tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import clip_year, dedupe, flag, prefix_columns


def repair_spell(df: DataFrame, start: str, end: str) -> DataFrame:
    """An end before the start becomes the start."""
    return df.withColumn(end, F.when(F.col(start) > F.col(end), F.col(start)).otherwise(F.col(end)))


def impute_years(df: DataFrame, start: str, end: str, snapshot: str, horizon: int, floor: int = 1950) -> DataFrame:
    """``start_year`` and ``end_year`` of each spell: missing bounds from the other, the snapshot, the horizon; clipped."""
    ys, ye, snap = F.year(start), F.year(end), F.col(snapshot)
    last = F.lit(horizon)
    first = clip_year(F.coalesce(ys, ye, snap, last), last, floor)
    upper = clip_year(F.coalesce(ye, snap, last), last, floor)
    return df.withColumns({"start_year": F.least(first, upper), "end_year": upper})


def expand_to_years(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row a year from ``start_year`` to ``end_year``, with 0/1 flags of the hire, exit and censored year."""
    out = df.withColumn("year", F.explode(F.sequence("start_year", "end_year")))
    known = lambda c: F.col(c).isNotNull() if c else F.lit(True)
    return out.withColumns(
        {
            "is_hire": flag(known(start) & (F.col("year") == F.col("start_year"))),
            "is_exit": flag(known(end) & (F.col("year") == F.col("end_year"))),
            "is_censored": flag(~known(end) & (F.col("year") == F.col("end_year"))),
        }
    )


@dataclass(frozen=True)
class Measure:
    """One column of a panel. ``how``: wmean, wsum, wvar, sum, avg, min, max, nunique, first (least value).

    ``denom`` of a weighted mean: ``observed`` divides by the weight of rows that have the value, ``all`` by that of all.
    """

    name: str
    column: str
    how: str = "wmean"
    denom: str = "observed"

    def expression(self, w: str) -> Column:
        x, wt = F.col(self.column), F.col(w)
        if self.how == "wmean":
            return F.try_divide(F.sum(x * wt), F.sum(F.when(x.isNotNull(), wt) if self.denom == "observed" else wt)).alias(self.name)
        simple = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "nunique": F.count_distinct, "first": F.min}
        return (F.sum(x * wt) if self.how == "wsum" else simple[self.how](x)).alias(self.name)


    def within(self, w: str, kind: str) -> Column:
        """The same where a group's distinct values can be held in one set."""
        if self.how == "nunique":
            return F.size(F.collect_set(_text(self.column, kind))).cast("long").alias(self.name)
        return self.expression(w)


def _text(c: str, kind: str) -> Column:
    """The value as text; -0.0 is 0.0."""
    return (F.col(c) + F.lit(0.0).cast(kind) if kind in ("double", "float") else F.col(c)).cast("string")


#: Rows of a group up to which its distinct values are held in sets, and rows of a task that reads groups whole.
GROUP_ROWS, TASK_ROWS = 200_000, 250_000
#: Rows of a narrow table that is sent to all executors at most.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """A lookup table for a join: sent to all executors up to ``BROADCAST_ROWS``, joined as Spark sees fit beyond."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def dealt(df: DataFrame, key: str, n_rows: int) -> DataFrame:
    """Rows of a key in one task, with as many tasks as keep each at ``TASK_ROWS`` rows on average."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // TASK_ROWS))
    return df.repartition(n, key)


def by_size(sizes: DataFrame, key: str, make: Callable[[DataFrame | None, str, bool], DataFrame], most: int | None = None) -> DataFrame:
    """``make`` over groups of up to ``most`` rows and, where there are any, over larger ones, united.

    ``sizes``: ``key, n``. ``make(large, how, whole)`` gets the keys of the large groups or None where there are none, the kind of join with
    them (``left_anti`` or ``left_semi``) that keeps its rows, and whether a group's rows may be read by one task.
    """
    large = sizes.where(F.col("n") > (GROUP_ROWS if most is None else most)).select(key)
    if large.isEmpty():
        return make(None, "", True)
    return make(large, "left_anti", True).unionByName(make(large, "left_semi", False))


def distinct_by_level(df: DataFrame, entity: str, levels: Mapping[str, str], n_rows: int) -> DataFrame:
    """``level, key, n``: the distinct entities at each value (as text) of each level's column, and of all rows at ``all, all``.

    Rows are dealt by entity once for all levels, and an entity's values are held in one set a level where its rows are: beyond
    that only counts are shuffled. A null value is a key of its own; a null entity does not count.
    """
    rows = df.where(F.col(entity).isNotNull()).select(entity, *levels.values())
    sets = [x for c in levels.values() for x in (F.collect_set(c).alias(c), F.bool_or(F.col(c).isNull()).alias(f"__{c}"))]
    held = dealt(rows, entity, n_rows).groupBy(entity).agg(*sets)
    values = lambda c: F.when(F.col(f"__{c}"), F.array_append(c, F.lit(None))).otherwise(F.col(c))
    keys = {"all": F.array(F.lit("all"))} | {level: values(c).cast("array<string>") for level, c in levels.items()}
    keys = F.array(*(F.struct(F.lit(level).alias("level"), x.alias("keys")) for level, x in keys.items()))
    return held.select(F.inline(keys)).select("level", F.explode("keys").alias("key")).groupBy("level", "key").agg(F.count(F.lit(1)).alias("n"))


def build_panel(df: DataFrame, keys: Sequence[str], weight: str, measures: Sequence[Measure], whole: bool = False) -> DataFrame:
    """All measures of each key: one plain aggregate of numbers, whose partial sums leave the map side.

    With ``whole`` rows are dealt by (some of) the keys already and no group is large: then all measures ride in one aggregate
    where the rows are, distinct values in a set for each group.

    Several distinct counts in one aggregate would send a wide copy of each row for each of them. They, and least or greatest
    texts, for which rows would be sorted, go through one narrow table ``keys, column, value``, deduplicated once
    (``distinct_values``) and joined to the plain part. A group without any value has a distinct count of 0.
    """
    kinds = dict(df.dtypes)
    if whole:
        return df.groupBy(*keys).agg(*(m.within(weight, kinds[m.column]) for m in measures))
    texts = [m for m in measures if m.how in ("first", "min", "max") and kinds[m.column] == "string"]
    counts = [m for m in measures if m.how == "nunique"]
    apart = [*counts, *texts] if len(counts) > 1 or texts else []
    plain = [m for m in measures if m not in apart]
    rows = df.groupBy(*keys).agg(*(m.expression(weight) for m in plain)) if plain else df.select(*keys).distinct()
    if not apart:
        return rows
    found = distinct_values(df, keys, list(dict.fromkeys(m.column for m in apart)), bool(texts))
    values = {"nunique": lambda c: F.coalesce(F.col(f"__{c}.n"), F.lit(0)), "max": lambda c: F.col(f"__{c}.high")}
    own = [values.get(m.how, lambda c: F.col(f"__{c}.low"))(m.column).alias(m.name) for m in apart]
    named = {k: f"__k_{k}" for k in keys}
    found = found.withColumnsRenamed(named)
    out = rows.join(found, [F.col(k).eqNullSafe(F.col(v)) for k, v in named.items()], "left") if keys else rows.crossJoin(found)  # one row each
    order = [m.name for m in measures]
    return out.select(*keys, *(m.name for m in plain), *own).select(*keys, *order)


def distinct_values(df: DataFrame, keys: Sequence[str], columns: Sequence[str], bounds: bool = True) -> DataFrame:
    """For each key and column a struct ``__<column>``: the number ``n`` of distinct values and, with ``bounds``, the ``low`` and ``high`` one as text.

    Rows become ``keys, column, value`` and are deduplicated before they are counted, so a key with very many values is
    spread over tasks by its values. Nulls do not count; -0.0 is 0.0.
    """
    kinds = dict(df.dtypes)
    pairs = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("__c"), _text(c, kinds[c]).alias("__v")) for i, c in enumerate(columns)))
    long = df.select(*keys, F.inline(pairs)).where("__v is not null").groupBy(*keys, "__c", "__v").agg(F.lit(1).alias("__one"))
    stats = {"n": F.count(F.lit(1))} | ({"low": F.min("__v"), "high": F.max("__v")} if bounds else {})
    rows = long.groupBy(*keys, "__c").agg(*(x.alias(n) for n, x in stats.items()))
    of = lambda i, n: F.max(F.when(F.col("__c") == i, F.col(n))).alias(n)
    return rows.groupBy(*keys).agg(*(F.struct(*(of(i, n) for n in stats)).alias(f"__{c}") for i, c in enumerate(columns)))


def stocks(spells: DataFrame, keys: Sequence[str], weight: str, start: str = "start_year", end: str = "end_year") -> DataFrame:
    """``keys, year, n_spells, stock, hires, exits`` of each year with a spell, by signed events and running sums.

    A spell adds at its start and takes away after its end, so rows do not grow with its length, as they do in
    ``expand_to_years``: events are summed by key and year first, and only these sums are filled up to all years of a key. Weights count to
    nine decimals, so that what is added and taken away cancels out.
    """
    w = F.col(weight).cast("decimal(28, 9)")
    none = F.lit(0).cast("decimal(28, 9)")
    at = F.array(
        F.struct(F.col(start).alias("year"), F.lit(1).alias("dn"), w.alias("dw"), w.alias("hires"), none.alias("exits")),
        F.struct(F.col(end).alias("year"), F.lit(0).alias("dn"), none.alias("dw"), none.alias("hires"), w.alias("exits")),
        F.struct((F.col(end) + 1).alias("year"), F.lit(-1).alias("dn"), (-w).alias("dw"), none.alias("hires"), none.alias("exits")),
    )
    sums = spells.where(f"{start} <= {end}").select(*keys, F.inline(at)).groupBy(*keys, "year").agg(*(F.sum(c).alias(c) for c in ("dn", "dw", "hires", "exits")))
    own = Window.partitionBy(*keys).orderBy("year")
    run = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumns({"n_spells": F.sum("dn").over(run), "stock": F.sum("dw").over(run), "next": F.lead("year").over(own)})
    years = sums.where("n_spells > 0").withColumn("y", F.explode(F.sequence("year", F.col("next") - 1)))
    first = F.col("y") == F.col("year")
    return years.select(*keys, F.col("y").alias("year"), "n_spells", F.col("stock").cast("double").alias("stock"), *(F.when(first, F.col(c).cast("double")).otherwise(0.0).alias(c) for c in ("hires", "exits")))


#: Groups whose means are sent to all executors at most; beyond that both sides are shuffled.
BROADCAST_GROUPS = 100_000


def with_means(df: DataFrame, keys: Sequence[str], means: Mapping[str, Column], small: bool | None = None) -> DataFrame:
    """Add group means to rows: partial sums leave the map side, and a small table of means comes back.

    Null keys are a group of their own. ``small`` says whether there are at most ``BROADCAST_GROUPS``; without it they
    are counted.
    """
    table = df.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(*(m.alias(n) for n, m in means.items()))
    if small is None:
        small = df.select(*keys).distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(F.broadcast(table) if small else table, on).drop(*(f"__{k}" for k in keys))


def weighted_variance(df: DataFrame, keys: Sequence[str], x: str, weight: str, out: str) -> DataFrame:
    """Weighted variance and SD of ``x`` in each cell, by its mean and the squared distances from it."""
    ok = df.where(F.col(x).isNotNull())
    ok = with_means(ok, keys, {"__mean": F.try_divide(F.sum(F.col(x) * F.col(weight)), F.sum(weight))})
    sums = ok.groupBy(*keys).agg(F.try_divide(F.sum(F.col(weight) * F.pow(F.col(x) - F.col("__mean"), 2)), F.sum(weight)).alias(out))
    return sums.withColumn(f"{out}_sd", F.sqrt(out))


def bundle_dispersion(shares: Sequence[Column]) -> Column:
    """Sum of p (1 - p)."""
    return sum((p * (1 - p) for p in shares[1:]), shares[0] * (1 - shares[0]))


def concentration(values: Sequence[Column]) -> Column:
    """Herfindahl index of a row's values; null where they sum to 0."""
    total = sum(values[1:], values[0])
    return F.try_divide(sum((v * v for v in values[1:]), values[0] * values[0]), total * total)


def first_events(df: DataFrame, key: str, date: str, flags: Mapping[str, Column]) -> DataFrame:
    """Date of the first row with each flag, for each key that has any: one conditional aggregate."""
    out = df.groupBy(key).agg(*(F.min(F.when(c, F.col(date))).alias(n) for n, c in flags.items()))
    return out.where(F.coalesce(*flags).isNotNull())


def adoption(df: DataFrame, year: str, first_year: str) -> DataFrame:
    """Event time, first-year, adopted-by-now and ever-adopter flags."""
    y, f = F.col(year), F.col(first_year)
    return df.withColumns({"event_time": y - f, "is_first_year": flag(y == f), "adopted": flag(y >= f), "ever_adopter": flag(f.isNotNull())})


def primary_record(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__at = 1").drop("__at")


def down(c: Column, date: bool = False) -> Column:
    """Part of an order for ``least_record``: from the greatest number or date to the least, nulls last."""
    return F.struct(c.isNull(), -(F.unix_date(c) if date else c))


def least_record(df: DataFrame, keys: Sequence[str], order: Sequence[Column], also: Mapping[str, Column] = {}) -> DataFrame:
    """The first row of each key by a total order, by one aggregate: a task sends one row a key, and no key's rows are gathered or ordered.

    ``order`` are columns, least and null first, or ``down`` of them. ``also`` adds aggregates over all rows of the key.
    """
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"), *(c.alias(n) for n, c in also.items()))
    return out.select(*keys, "__first.*", *also).select(*df.columns, *also)


def shifted(column: str, ids: Sequence[str], year: str, by: int, calendar: bool = False) -> Column:
    """The value ``by`` rows ahead (behind if negative), or ``by`` calendar years with ``calendar``: null over a gap."""
    w = Window.partitionBy(*ids).orderBy(year)
    if calendar:
        return F.first(column).over(w.rangeBetween(by, by))
    return F.lead(column, by).over(w) if by >= 0 else F.lag(column, -by).over(w)


def growth(now: Column, ahead: Column) -> Column:
    """100 times the log growth; null unless both are positive."""
    return F.when((now > 0) & (ahead > 0), 100 * (F.log(ahead) - F.log(now)))


def entity_lookup(companies: DataFrame, child: str, direct: str, child_columns: Mapping[str, str], direct_columns: Mapping[str, str], key: str = "entity") -> DataFrame:
    """One row an entity, children and direct ones united: ``key`` and the named columns, each the least known value.

    ``child_columns`` and ``direct_columns`` name for each output column where it stands in a child's and in a direct row.
    Rows without an id are left out; rows that say the same count once.
    """
    sides = [companies.select(F.col(k).alias(key), *(F.col(c).alias(n) for n, c in names.items())).where(F.col(key).isNotNull()) for k, names in ((child, child_columns), (direct, direct_columns))]
    return sides[0].unionByName(sides[1]).groupBy(key).agg(*(F.min(n).alias(n) for n in child_columns))


def outer_join_all(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(on), "full_outer")
    return out


def attach(panel: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str = "", order: Sequence[Column] | None = None) -> DataFrame:
    """Left join of a table that has one row a key, its columns under ``prefix``; with ``order`` it is deduplicated by it first."""
    right = dedupe(right, keys, order) if order else right
    return panel.join(prefix_columns(right, prefix, keys) if prefix else right, list(keys), "left")


def age(year: Column, founded: Column) -> Column:
    """Years since the founding; null before it."""
    return F.when(year >= founded, year - founded)
