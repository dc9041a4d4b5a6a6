"""Audits and profiles of panels: keys, columns, years, entities, distributions; one pass each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .io import released, stable, verify

NUMERIC = (T.NumericType,)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def key_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, duplicated keys, excess rows, most and mean rows of a duplicated key."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    dup = F.when(F.col("n") > 1, F.col("n"))
    return n.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.count(dup).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess_rows"), F.max(dup).alias("max_dup"), F.avg(dup).alias("avg_dup"),
    )


def top_duplicates(df: DataFrame, keys: Sequence[str], n: int = 25) -> DataFrame:
    """The ``n`` most repeated keys."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counts.orderBy(F.desc("n"), *keys).limit(n)


def duplicate_rows(df: DataFrame, keys: Sequence[str], n: int = 25) -> DataFrame:
    """All rows of the ``n`` most repeated keys; the key list has ``n`` rows at most."""
    return df.join(F.broadcast(top_duplicates(df, keys, n).drop("n")), list(keys), "left_semi")


def column_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """``column, dtype, n_null, null_share, n_distinct``: one aggregate over all columns, made long."""
    def missing(f: T.StructField) -> Column:
        c = F.col(f.name)
        return c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.isNull()

    count = F.count_distinct if exact else F.approx_count_distinct
    parts = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.count_if(missing(f)).alias("n_null"), F.try_divide(F.count_if(missing(f)), F.count(F.lit(1))).alias("null_share"), count(f.name).alias("n_distinct")) for f in df.schema]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, min, max, mean, sd`` of numeric columns, in one aggregate."""
    d = lambda c: F.col(c).cast("double")
    parts = [F.struct(F.lit(c).alias("column"), F.min(d(c)).alias("min"), F.max(d(c)).alias("max"), F.avg(d(c)).alias("mean"), F.stddev_samp(d(c)).alias("sd")) for c in columns or numeric_columns(df)]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def by_year(df: DataFrame, year: str, entity: str) -> DataFrame:
    return df.groupBy(year).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(entity).alias("n_entities"))


def year_span(df: DataFrame, year: str) -> DataFrame:
    return df.agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count_distinct(year).alias("n_years"))


def top_entities(df: DataFrame, entity: str, n: int = 25) -> DataFrame:
    """The ``n`` entities with most rows."""
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), entity).limit(n)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, at: Mapping[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles of each group, one column for each name in ``at``: all groups at once.

    Equal values are counted first, and the counts are dealt in ranges of group and value, so a group with very many values
    spreads over as many tasks as it needs. Sums by group and range tell in which range each wanted rank lies; only
    these ranges are ordered and searched. Nulls do not count; a group without values has no row.
    """
    spark = df.sparkSession
    keys = [f"__g{i}" for i in range(len(by))] or ["__g"]
    groups = [F.col(b).alias(k) for b, k in zip(by, keys, strict=False)] or [F.lit(1).alias("__g")]
    with released(spark):
        counts = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("x")).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n"))
        n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        dealt = stable(counts.repartitionByRange(n_ranges, *keys, "x").withColumn("part", F.spark_partition_id()))
        before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = dealt.groupBy(*keys, "part").agg(F.sum("n").alias("own")).withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0)))
        parts = stable(parts.withColumn("total", F.sum("own").over(Window.partitionBy(*keys))))
        place = lambda q: F.lit(float(q)) * (F.col("total") - 1)
        ranks = F.array(*(F.struct(F.lit(name).alias("name"), f(place(q)).cast("long").alias("rank")) for name, q in at.items() for f in (F.floor, F.ceil)))
        wanted = parts.select(*keys, "part", "before", "own", F.inline(F.array_distinct(ranks))).where("rank >= before and rank < before + own")
        run = Window.partitionBy(*keys, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        some = dealt.join(wanted.select(*keys, "part").distinct(), _same([*keys, "part"], dealt, wanted), "left_semi").withColumn("up_to", F.sum("n").over(run))
        found = some.alias("s").join(wanted.alias("w"), [F.col(f"s.{k}").eqNullSafe(F.col(f"w.{k}")) for k in [*keys, "part"]])
        found = found.where("w.rank - w.before < s.up_to and w.rank - w.before >= s.up_to - s.n").groupBy(*(F.col(f"w.{k}").alias(k) for k in keys), "name").agg(F.min("rank").alias("low"), F.min("x").alias("a"), F.max("x").alias("b"))
        totals = parts.groupBy(*keys).agg(F.max("total").alias("total"))
        found = found.alias("f").join(totals.alias("t"), [F.col(f"f.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
        share = F.element_at(F.create_map(*(F.lit(x) for name, q in at.items() for x in (name, float(q)))), F.col("name")) * (F.col("total") - 1) - F.col("low")
        x = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + share * (F.col("b") - F.col("a")))
        rows = found.select(*(F.col(f"f.{k}").alias(k) for k in keys), "name", x.alias("x"))
        out = rows.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in at))
        return stable(out.select(*(F.col(k).alias(b) for b, k in zip(by, keys, strict=False)), *at), keep=True)


def _same(keys: Sequence[str], a: DataFrame, b: DataFrame) -> list[Column]:
    return [a[k].eqNullSafe(b[k]) for k in keys]


def rows_per_entity(df: DataFrame, entity: str, exact: bool = True) -> DataFrame:
    """Min, median, 90th and 99th percentile and max of the rows of an entity; ``exact`` or approximate."""
    n = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    names = {"min": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "max": 1.0}
    if exact:
        found = exact_quantiles(n, [], "n", names)
        return found.select(*(F.col(c).cast("long").alias(c) if c in ("min", "max") else c for c in names))
    q = lambda p: F.percentile_approx("n", p, 10_000)
    return n.agg(F.min("n").alias("min"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.max("n").alias("max"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def status(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: whether there are rows, how many columns, whether the key is unique."""
    r = key_report(df, keys)
    return r.select((F.col("n_rows") > 0).alias("has_rows"), F.lit(len(df.columns)).alias("n_columns"), (F.col("excess_rows") == 0).alias("key_ok"))


def table_status(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """``status`` of a table on disk with ``files_ok`` from its manifest (``io.write_verified``); false where the write was not finished."""
    checked = verify(spark, path, rows=False).select(F.coalesce(F.col("finished") & F.col("files_ok"), F.lit(False)).alias("files_ok"))
    return checked.crossJoin(F.broadcast(status(spark.read.parquet(path), keys)))  # one row each


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``keys, variable, value``: a row for each column."""
    pairs = F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(*keys, F.inline(pairs))


def variable_study(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), quantiles: Sequence[float] = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99), exact: bool = True, positive: bool = False, support: str | None = None) -> DataFrame:
    """Shares of missing, zero and positive, mean and quantiles of each variable and group, over all values.

    Quantiles are ``exact`` (``exact_quantiles``, all variables and groups at once) or approximate in the same pass.
    ``positive`` adds ``n_positive`` and ``pos_``-prefixed mean and quantiles of the positive values; ``support`` names a
    0/1 column whose rows alone are studied.
    """
    df = df.where(F.col(support) == 1) if support else df
    v, n = F.col("value"), F.count(F.lit(1))
    over = F.when(v > 0, v)
    names = {f"p{round(q * 100):02d}": float(q) for q in quantiles}
    sides = {"": v, "pos_": over} if positive else {"": v}
    stats = [F.try_divide(F.count_if(c), n).alias(k) for k, c in (("missing_share", v.isNull()), ("zero_share", v == 0), ("positive_share", v > 0))]
    stats.append(F.avg("value").alias("mean"))
    if positive:
        stats += [F.count(over).alias("n_positive"), F.avg(over).alias("pos_mean")]
    if not exact:
        stats += [F.percentile_approx(x, q, 10_000).alias(p + c) for p, x in sides.items() for c, q in names.items()]
    long, keys = long_form(df, by, columns), ["variable", *by]
    out = long.groupBy(*keys).agg(n.alias("n"), *stats)
    for p, x in sides.items() if exact else ():
        found = exact_quantiles(long.withColumn("value", x), keys, "value", names)
        found = found.withColumnsRenamed({k: f"__{k}" for k in keys} | {c: p + c for c in names})
        out = out.join(found, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*(f"__{k}" for k in keys))
    return out


def correlations(df: DataFrame, columns: Sequence[str], counts: bool = False) -> DataFrame:
    """Symmetric long table of Pearson correlations, all pairs in one aggregate; ``counts`` adds the rows ``n``."""
    n = [F.count(F.lit(1)).alias("n")] if counts else []
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"), *n) for a in columns for b in columns]
    return df.agg(F.array(*cells).alias("p")).select(F.inline("p"))


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    """Counts in bins of fixed width; what is 1 or more goes to the last bin below 1."""
    v = F.col(column)
    left = F.when(v >= 1, F.lit(1 - width)).otherwise(F.floor(v / width) * width)
    return df.where(v.isNotNull()).groupBy(F.round(left, 6).alias("bin_left")).agg(F.count(F.lit(1)).alias("n")).withColumn("bin_right", F.round(F.col("bin_left") + width, 6))


def schema_manifest(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Which of the wanted columns exist, and their types."""
    types = dict(df.dtypes)
    return df.sparkSession.createDataFrame([(c, c in types, types.get(c)) for c in wanted], "variable string, present boolean, dtype string")


def compared(df: DataFrame, columns: Sequence[str], support: str, **how) -> DataFrame:
    """The study of all rows and of those with support, side by side: columns ``all_`` and ``if_``."""
    sides = [variable_study(df, columns, support=s, **how) for s in (None, support)]
    a, b = (d.select("variable", *(F.col(c).alias(f"{p}_{c}") for c in d.columns if c != "variable")) for d, p in zip(sides, ("all", "if"), strict=True))
    return a.join(b, "variable", "left")


def flagged_rows(df: DataFrame, flag: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The flagged rows in order, with those of ``columns`` that there are."""
    return df.where(F.col(flag) == 1).select(*(c for c in columns if c in df.columns)).orderBy(*order)
