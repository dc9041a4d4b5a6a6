"""Registered queries of regressions, indices, event paths, variable studies, sources and scalar helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, clean, io, panel, regress, sketches
from .queries import _query, _t, r


def _robust_sql(model: str, y: str, x: str, fe: str | None, winsorised: bool, standardised: bool) -> str:
    """SQL of one regressor's OLS with CR1 errors by supplier, with or without one-way effects."""
    clip = f"least(greatest({y}, (SELECT quantile_cont({y}, 0.01) FROM lineitem)), (SELECT quantile_cont({y}, 0.99) FROM lineitem))" if winsorised else y
    unit = f"({x} - (SELECT avg({x}) FROM lineitem)) / (SELECT stddev_samp({x}) FROM lineitem)" if standardised else x
    over = f"OVER (PARTITION BY {fe})" if fe else "OVER ()"
    k = f"2 + (SELECT count(DISTINCT {fe}) FROM lineitem) - 1" if fe else "2"
    return f"""SELECT '{model}' AS model, 'l_quantity' AS term, round(b, 4) AS coef, round(se, 4) AS se, n, clusters, round(1 - rss / tss, 6) AS r2, round(y_mean, 2) AS y_mean, round(y_sd, 2) AS y_sd FROM (
  WITH d AS (SELECT l_suppkey AS g, {clip} AS raw, {clip} - avg({clip}) {over} AS y, {unit} - avg({unit}) {over} AS x FROM lineitem), e AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, avg(raw) AS y_mean, stddev_samp(raw) AS y_sd FROM d),
  s AS (SELECT g, sum(x * (y - b * x)) AS s, sum((y - b * x) * (y - b * x)) AS rss FROM d, e GROUP BY g)
  SELECT any_value(b) AS b, sqrt(count(*) / (count(*) - 1.0) * (any_value(n) - 1) / (any_value(n) - ({k})) * sum(s * s)) / any_value(sxx) AS se, any_value(n) AS n, count(*) AS clusters, sum(rss) AS rss,
    any_value(y_sd) * any_value(y_sd) * (any_value(n) - 1) AS tss, any_value(y_mean) AS y_mean, any_value(y_sd) AS y_sd FROM s, e)"""


_SPECS = (("OLS", False, False, False), ("OLS_FE", True, False, False), ("OLS_FE_STD", True, True, False), ("OLS_FE_WIN", True, False, True))


def _four_models(spark: SparkSession, d: str) -> list[dict]:
    t = _t(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity", F.pmod("l_partkey", F.lit(25)).alias("brand_year"))
    found = regress.fe_ols_specs(t, "l_extendedprice", ["l_quantity"], "l_suppkey", ["brand_year"], {m: own for m, *own in _SPECS})
    return [{"model": model, **x} for model, rows in found.items() for x in rows]


_FOUR = " UNION ALL ".join(_robust_sql(m, "l_extendedprice", "l_quantity", "l_partkey % 25" if fe else None, win, std) for m, fe, std, win in _SPECS)


@_query(f"SELECT model, term, coef, se, n, clusters, r2 FROM ({_FOUR})")
def r3_one_way_fe(spark: SparkSession, d: str) -> DataFrame:
    """Four specifications, with and without one-way effects, standardised and winsorised, clustered errors."""
    return regress.result_table(spark, _four_models(spark, d)).select("model", "term", r("coef").alias("coef"), r("se").alias("se"), "n", "clusters", r("r2", 6).alias("r2"))


@_query(f"SELECT model, n, clusters, r2, y_mean, y_sd FROM ({_FOUR})")
def r14_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Rows, clusters, fit and the outcome's mean and SD of each model."""
    out = regress.result_table(spark, regress.diagnostics(_four_models(spark, d), ["model"]))
    return out.select("model", "n", "clusters", r("r2", 6).alias("r2"), r("y_mean", 2).alias("y_mean"), r("y_sd", 2).alias("y_sd"))


@_query()
def r1_two_way_fe(spark: SparkSession, d: str) -> DataFrame:
    """Two-way within transform to convergence and cluster-robust errors (tested against dummies)."""
    t = regress.standardise(_t(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), "l_extendedprice", "l_quantity"), "l_quantity")
    t = regress.residualise_fast(t, ["l_extendedprice", "l_quantity"], ["l_suppkey"], ["year"])
    rows = regress.cluster_ols(t, "l_extendedprice", ["l_quantity"], "l_suppkey", constant=False)
    return regress.result_table(spark, rows).select("term", *(r(c).alias(c) for c in ("coef", "se", "low", "high", "r2")), "n", "clusters")


@_query("""WITH p AS (SELECT s_nationkey AS parent, year(l_shipdate) AS year, avg(l_extendedprice) AS y, avg(l_quantity) AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
e AS (SELECT parent, year, y, x FROM (SELECT p.*, count(*) OVER (PARTITION BY parent) AS c FROM p) WHERE c = (SELECT count(DISTINCT year) FROM p)),
d AS (SELECT parent, y - avg(y) OVER (PARTITION BY parent) - avg(y) OVER (PARTITION BY year) + avg(y) OVER () AS y, x - avg(x) OVER (PARTITION BY parent) - avg(x) OVER (PARTITION BY year) + avg(x) OVER () AS x FROM e),
b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, sum(y * y) AS tss, count(*) AS n FROM d), s AS (SELECT parent, sum(x * (y - b * x)) AS s, sum((y - b * x) * (y - b * x)) AS rss FROM d, b GROUP BY parent)
SELECT 'x' AS term, round(any_value(b), 4) AS coef, round(sqrt(count(*) / (count(*) - 1.0) * (any_value(n) - 1) / (any_value(n) - 1) * sum(s * s)) / any_value(sxx), 4) AS se, round(1 - sum(rss) / any_value(tss), 6) AS r2, any_value(n) AS n, count(*) AS clusters,
  (SELECT count(DISTINCT parent) + count(DISTINCT year) - 1 FROM e) AS degrees FROM s, b""")
def r1_balanced_panel(spark: SparkSession, d: str) -> DataFrame:
    """Two-way effects on a balanced panel, where the within transform has a closed form, and the effects' degrees of freedom."""
    line, s = _t(spark, d, "lineitem"), _t(spark, d, "supplier")
    p = line.join(s, line.l_suppkey == s.s_suppkey).groupBy(F.col("s_nationkey").alias("parent"), F.year("l_shipdate").alias("year")).agg(F.avg("l_extendedprice").alias("y"), F.avg("l_quantity").alias("x"))
    p = io.stable(p)
    whole = p.groupBy("parent").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == p.select("year").distinct().count()).select("parent")
    p = io.stable(p.join(whole, "parent", "left_semi"))
    within = regress.residualise_fast(p, ["y", "x"], ["parent"], ["year"])
    out = regress.result_table(spark, regress.cluster_ols(within, "y", ["x"], "parent", constant=False))
    return out.select("term", r("coef").alias("coef"), r("se").alias("se"), r("r2", 6).alias("r2"), "n", "clusters", F.lit(regress.effect_degrees(p, ["parent"], ["year"])).cast("long").alias("degrees"))


@_query("WITH b AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem), w AS (SELECT l_returnflag, least(greatest(l_extendedprice, lo), hi) AS y FROM lineitem, b) SELECT l_returnflag, round(avg(y), 2) AS mean, round(min(y), 2) AS low, round(max(y), 2) AS high FROM w GROUP BY 1")
def r4_winsorise(spark: SparkSession, d: str) -> DataFrame:
    """Clipping at exact quantiles."""
    w = regress.winsorise(_t(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice")
    return w.groupBy("l_returnflag").agg(r(F.avg("l_extendedprice"), 2).alias("mean"), r(F.min("l_extendedprice"), 2).alias("low"), r(F.max("l_extendedprice"), 2).alias("high"))


_GROUPS = {"composite": ["m1", "m2", "m3"], "group_a": ["m1", "m2"], "group_b": ["m2", "m3"], "group_c": ["m3"]}
_INDEX = f"""m AS (SELECT p_brand || '|' || p_type AS occ, avg(l_quantity) AS m1, avg(l_tax) AS m2, avg(l_discount) AS m3 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) BETWEEN 1996 AND 1998 GROUP BY 1),
z AS (SELECT occ, {", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}" for c in ("m1", "m2", "m3"))} FROM m),
v AS (SELECT occ, {", ".join(f"({' + '.join(own)}) / {len(own)} AS visibility_{g}" for g, own in _GROUPS.items())} FROM z),
idx AS (SELECT occ, {", ".join(f"visibility_{g}, CAST(visibility_{g} >= (SELECT quantile_cont(visibility_{g}, 0.9) FROM v) AS INT) AS top_decile_{g}" for g in _GROUPS)} FROM v)"""


def _occupation_rows(spark: SparkSession, d: str) -> DataFrame:
    line, part = _t(spark, d, "lineitem"), _t(spark, d, "part")
    rows = line.join(part, line.l_partkey == part.p_partkey)
    return rows.withColumns({"occ": F.concat_ws("|", "p_brand", "p_type"), "year": F.year("l_shipdate"), "m1": F.col("l_quantity"), "m2": F.col("l_tax"), "m3": F.col("l_discount")})


def _index(spark: SparkSession, d: str) -> DataFrame:
    return regress.visibility_index(_occupation_rows(spark, d), "occ", _GROUPS, "year", 1996, 1998)


@_query(f"WITH {_INDEX} SELECT occ, {', '.join(f'round(visibility_{g}, 6) AS visibility_{g}, top_decile_{g}' for g in _GROUPS)} FROM idx")
def r6_occupation_index(spark: SparkSession, d: str) -> DataFrame:
    """Means by occupation in a window before, z-scored over occupations and averaged in four groups, with top-decile flags."""
    out = _index(spark, d)
    return out.withColumns({f"visibility_{g}": r(f"visibility_{g}", 6) for g in _GROUPS})


@_query(f"""WITH {_INDEX}, c AS (SELECT s_nationkey AS parent, p_brand || '|' || p_type AS occ, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n_workers, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT c.*, round(visibility_composite, 6) AS visibility_composite, top_decile_group_a, round(q * visibility_composite, 4) AS treat, round(CASE WHEN q > 0 THEN ln(q) END, 6) AS level_control FROM c LEFT JOIN idx USING (occ)""")
def j13_index_attach(spark: SparkSession, d: str) -> DataFrame:
    """The occupation index on parent x occupation x year cells, its interaction with a treatment, the log level control."""
    out = panel.attach(_cells(spark, d), _index(spark, d).select("occ", "visibility_composite", "top_decile_group_a"), ["occ"])
    out = regress.interacted(out, "q", "visibility_composite", "treat", "q", log_level=True)
    return out.withColumns({"visibility_composite": r("visibility_composite", 6), "treat": r("treat"), "level_control": r("level_control", 6)})


def _cells(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier")
    rows = _occupation_rows(spark, d)
    return rows.join(s, rows.l_suppkey == s.s_suppkey).groupBy(F.col("s_nationkey").alias("parent"), "occ", "year").agg(F.count(F.lit(1)).alias("n_workers"), F.sum("l_quantity").alias("q"))


@_query()
def r11_robustness_grid(spark: SparkSession, d: str) -> DataFrame:
    """Two-way estimates over named samples, outcomes, indices, plain and winsorised (tested against dummies), and the views that each is in."""
    cells = panel.attach(_cells(spark, d), _index(spark, d), ["occ"]).withColumns({"log_n": clean.log_positive(F.col("n_workers")), "log_q": clean.log_positive(F.col("q")), "industry": F.pmod("parent", F.lit(5))})
    rows = regress.robustness_grid(cells, ["log_q", "q"], "n_workers", ["visibility_composite", "visibility_group_a"], ["log_n"], ["industry"], ["year"], "parent")
    out = regress.result_table(spark, rows)
    views = (F.when(c, F.lit(name)) for name, c in regress.slice_conditions("n_workers", "visibility_composite").items())
    return out.withColumn("views", F.concat_ws(",", *views)).select("sample", "outcome", "index_name", "winsorised", "term", "views", *(r(c, 6).alias(c) for c in ("coef", "se", "low", "high", "r2")), "n", "clusters")


@_query(f"""WITH {_INDEX}, c AS (SELECT s_nationkey AS parent, p_brand || '|' || p_type AS occ, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n_workers FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), j AS (SELECT * FROM c LEFT JOIN idx USING (occ))
SELECT 'baseline' AS sample, count(*) AS n FROM j UNION ALL SELECT 'min_workers_20', count(*) FROM j WHERE n_workers >= 20 UNION ALL SELECT 'min_workers_50', count(*) FROM j WHERE n_workers >= 50
UNION ALL SELECT 'drop_top_group_a_decile', count(*) FROM j WHERE top_decile_group_a <> 1 UNION ALL SELECT 'drop_top_group_b_decile', count(*) FROM j WHERE top_decile_group_b <> 1
UNION ALL SELECT 'drop_top_any_decile', count(*) FROM j WHERE top_decile_group_a <> 1 AND top_decile_group_b <> 1""")
def p28_samples(spark: SparkSession, d: str) -> DataFrame:
    """The rows that each named sample keeps, one result below the other."""
    cells = io.stable(panel.attach(_cells(spark, d), _index(spark, d), ["occ"]))
    counts = [clean.sample_filter(cells, name).agg(F.lit(name).alias("sample"), F.count(F.lit(1)).alias("n")) for name in clean.SAMPLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


_RESIDUAL = """b AS (SELECT l_suppkey AS f, l_extendedprice AS y, l_quantity AS x, l_tax AS c FROM lineitem), d AS (SELECT y - avg(y) OVER p AS y, x - avg(x) OVER p AS x, c - avg(c) OVER p AS c FROM b WINDOW p AS (PARTITION BY f)),
k AS (SELECT sum(c * y) / sum(c * c) AS b_y, sum(c * x) / sum(c * c) AS b_x FROM d), res AS (SELECT y - b_y * c AS y, x - b_x * c AS x FROM d, k)"""


@_query(f"""WITH {_RESIDUAL}, e AS (SELECT list_distinct(quantile_cont(x, {[i / 20 for i in range(21)]})) AS e FROM res), bins AS (SELECT greatest(len(list_filter(e, lambda z: z < x)), 1) AS bin, x, y FROM res, e),
m AS (SELECT CAST(bin AS INT) AS bin, avg(x) AS mean_x, avg(y) AS mean_y, count(*) AS n FROM bins GROUP BY bin) SELECT bin, round(mean_x, 3) AS mean_x, round(mean_y, 1) AS mean_y, n, round(regr_slope(mean_y, mean_x) OVER (), 4) AS slope, round(regr_intercept(mean_y, mean_x) OVER (), 3) AS intercept FROM m""")
def r8_binscatter(spark: SparkSession, d: str) -> DataFrame:
    """Bin means of what fixed effects and a control do not explain, with the line through them."""
    b = regress.binscatter(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 20, ["l_tax"], ["l_suppkey"])
    return b.select(F.col("bin").cast("int").alias("bin"), r("mean_x", 3).alias("mean_x"), r("mean_y", 1).alias("mean_y"), "n", r("slope").alias("slope"), r("intercept", 3).alias("intercept"))


_EVENTS = "SELECT CAST(date_diff('year', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INT) AS event_time, l_extendedprice AS y, l_quantity AS idx FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _event_rows(spark: SparkSession, d: str) -> DataFrame:
    line, o = _t(spark, d, "lineitem"), _t(spark, d, "orders")
    return line.join(o, line.l_orderkey == o.o_orderkey).withColumn("event_time", F.year("l_shipdate") - F.year("o_orderdate"))


@_query(f"SELECT event_time, round(avg(y), 2) AS mean, round(stddev_samp(y) / sqrt(count(*)), 2) AS se, count(*) AS n FROM ({_EVENTS}) GROUP BY 1")
def r9_event_path(spark: SparkSession, d: str) -> DataFrame:
    """Mean path by event time with standard errors."""
    return regress.event_path(_event_rows(spark, d), "event_time", "l_extendedprice").select("event_time", r("mean", 2).alias("mean"), r("se", 2).alias("se"), "n")


@_query(f"WITH e AS (SELECT * FROM ({_EVENTS}) WHERE event_time BETWEEN -3 AND 3) SELECT event_time, CASE WHEN idx >= (SELECT quantile_cont(idx, 0.5) FROM e) THEN 'high' ELSE 'low' END AS half, round(avg(y), 2) AS mean, round(stddev_samp(y) / sqrt(count(*)), 2) AS se, count(*) AS n FROM e GROUP BY ALL")
def r10_event_split(spark: SparkSession, d: str) -> DataFrame:
    """Event paths of rows at or over the median of an index and under it, within a window."""
    out = regress.event_path_by_split(_event_rows(spark, d), "event_time", "l_extendedprice", "l_quantity", 3)
    return out.select("event_time", "half", r("mean", 2).alias("mean"), r("se", 2).alias("se"), "n")


@_query("WITH n AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1 HAVING count(*) >= 8 AND avg(o_totalprice) >= 100000) SELECT o_orderkey, o_custkey FROM orders SEMI JOIN n USING (o_custkey)")
def r12_entity_filter(spark: SparkSession, d: str) -> DataFrame:
    """Entities with enough rows and size, by a semi join."""
    o = _t(spark, d, "orders")
    kept = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m")).where("n >= 8 and m >= 100000")
    return o.join(kept, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


_QS = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
_POSITIVE = ", ".join(["count(CASE WHEN v > 0 THEN 1 END) AS n_positive", "round(avg(CASE WHEN v > 0 THEN v END), 4) AS pos_mean", *(f"round(quantile_cont(CASE WHEN v > 0 THEN v END, {q}), 4) AS pos_p{round(q * 100):02d}" for q in _QS)])
_SHARES = "count(*) AS n, round(count(CASE WHEN v IS NULL THEN 1 END) / count(*), 6) AS missing_share, round(count(CASE WHEN v = 0 THEN 1 END) / count(*), 6) AS zero_share, round(count(CASE WHEN v > 0 THEN 1 END) / count(*), 6) AS positive_share, round(avg(v), 4) AS mean, " + ", ".join(f"round(quantile_cont(v, {q}), 4) AS p{round(q * 100):02d}" for q in _QS)
_LONG = "l AS (SELECT 'l_tax' AS variable, l_tax AS v, l_quantity > 25 AS s, CAST(year(l_shipdate) AS INT) AS year FROM lineitem UNION ALL SELECT 'l_discount', l_discount, l_quantity > 25, CAST(year(l_shipdate) AS INT) FROM lineitem)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r(c, 6 if c.endswith("_share") else 4) for c, t in df.dtypes if t == "double"})


def _supported(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").withColumns({"year": F.year("l_shipdate"), "support": clean.flag(F.col("l_quantity") > 25)})


@_query(f"WITH {_LONG} SELECT variable, {_SHARES}, {_POSITIVE} FROM l GROUP BY variable")
def d9_variable_study(spark: SparkSession, d: str) -> DataFrame:
    """Shares, mean and quantiles of all and of the positive values in one pass."""
    return _rounded(audit.variable_study(_supported(spark, d), ["l_tax", "l_discount"], positive=True))


@_query(f"WITH {_LONG} SELECT variable, year, {_SHARES} FROM l WHERE s GROUP BY variable, year")
def d10_yearly_study(spark: SparkSession, d: str) -> DataFrame:
    """By year, of the rows with support."""
    return _rounded(audit.variable_study(_supported(spark, d), ["l_tax", "l_discount"], ["year"], support="support"))


_SIDE = lambda p, where: f"SELECT variable AS v{p}, n AS {p}_n, missing_share AS {p}_missing_share, zero_share AS {p}_zero_share, positive_share AS {p}_positive_share, mean AS {p}_mean, {', '.join(f'p{round(q * 100):02d} AS {p}_p{round(q * 100):02d}' for q in _QS)} FROM (SELECT variable, {_SHARES} FROM l {where} GROUP BY variable)"


@_query(f"WITH {_LONG}, a AS ({_SIDE('all', '')}), b AS ({_SIDE('if', 'WHERE s')}) SELECT vall AS variable, a.* EXCLUDE (vall), b.* EXCLUDE (vif) FROM a LEFT JOIN b ON vall = vif")
def d12_conditional_study(spark: SparkSession, d: str) -> DataFrame:
    """The whole study of all rows against rows with support, side by side."""
    return _rounded(audit.compared(_supported(spark, d), ["l_tax", "l_discount"], "support"))


@_query("WITH l AS (SELECT 'l_tax' AS variable, l_tax AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem) SELECT variable, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.9) AS p90, count(DISTINCT v) AS n_distinct FROM l GROUP BY variable")
def a24_approximate(spark: SparkSession, d: str) -> DataFrame:
    """Approximate quantiles and distinct counts; on columns of so few values they are exact."""
    t = _t(spark, d, "lineitem")
    out = audit.variable_study(t, ["l_tax", "l_discount"], quantiles=(0.5, 0.9), exact=False).select("variable", "p50", "p90")
    distinct = audit.column_profile(t.select("l_tax", "l_discount")).select(F.col("column").alias("variable"), F.col("n_distinct").cast("long"))
    return out.join(distinct, "variable")


@_query("SELECT CAST(min(year(o_orderdate)) AS INT) AS first_year, CAST(max(year(o_orderdate)) AS INT) AS last_year, count(DISTINCT year(o_orderdate)) AS n_years FROM orders")
def d5_year_span(spark: SparkSession, d: str) -> DataFrame:
    """First, last and number of years."""
    return audit.year_span(_t(spark, d, "orders").withColumn("year", F.year("o_orderdate")), "year")


@_query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 25")
def d6_top_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entities with most rows (a top-k report)."""
    return audit.top_entities(_t(spark, d, "orders"), "o_custkey")


@_query("WITH w AS (SELECT unnest(['o_orderkey', 'o_custkey', 'o_comment', 'o_totalprice']) AS variable) SELECT variable, CAST(count(name) > 0 AS BOOLEAN) AS available FROM w LEFT JOIN (SELECT name FROM pragma_table_info('orders')) ON name = variable GROUP BY variable")
def d13_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Which wanted columns a table has."""
    return audit.schema_manifest(_t(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_comment", "o_totalprice"]).select("variable", F.col("present").alias("available"))


@_query("SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")
def x2_distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    """Deduplication on all columns."""
    return _t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_tax").dropDuplicates()


@_query("""SELECT l_orderkey, l_linenumber, least(greatest(year(l_shipdate), 1997), 1999)::INT AS clipped, CASE WHEN l_shipdate >= o_orderdate THEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) END AS days, CAST(l_quantity AS INT) AS qty,
round(CASE WHEN l_tax > 0 THEN ln(l_tax) END, 6) AS log_tax, round(sqrt(l_quantity), 6) AS root_qty, l_suppkey || '_y' || year(l_shipdate) AS fe FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount > 0""")
def p_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Casts, clipped years, durations, logs, roots, joint labels, a column by availability, a restriction."""
    line, o = _t(spark, d, "lineitem"), _t(spark, d, "orders")
    rows = clean.restrict(line.join(o, line.l_orderkey == o.o_orderkey).withColumn("qty", F.col("l_quantity").cast("string")), share="l_discount")
    rows = clean.cast_if_present(clean.cast_if_present(rows.withColumn("qty", F.expr("CAST(CAST(qty AS DOUBLE) AS INT)").cast("string")), "qty", "int"), "not_there", "int")
    firm = F.col(clean.first_column(rows, ["finest_firm", "l_suppkey", "o_custkey"]))
    year = F.year("l_shipdate")
    return rows.select(
        "l_orderkey", "l_linenumber", clean.clip_year(year, F.lit(1999), 1997).alias("clipped"), clean.duration_days(F.to_date("o_orderdate"), F.to_date("l_shipdate")).alias("days"), "qty",
        r(clean.log_positive(F.col("l_tax")), 6).alias("log_tax"), r(clean.root(F.col("l_quantity")), 6).alias("root_qty"), clean.joint_label(firm, year).alias("fe"),
    )


@_query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN year(o_orderdate) END AS ys, CASE WHEN o_orderkey % 5 <> 0 THEN year(o_orderdate) + 1 END AS ye, CASE WHEN o_orderkey % 7 <> 0 THEN 1999 END AS snap FROM orders),
b AS (SELECT o_orderkey, least(greatest(coalesce(ys, ye, snap, 2001), 1950), 2001) AS first, least(greatest(coalesce(ye, snap, 2001), 1950), 2001) AS last FROM s) SELECT o_orderkey, CAST(least(first, last) AS INT) AS start_year, CAST(last AS INT) AS end_year FROM b""")
def p19_impute_years(spark: SparkSession, d: str) -> DataFrame:
    """Missing bounds of spells from the other bound, a snapshot year and the horizon."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = _t(spark, d, "orders").select(k, F.when(k % 3 != 0, day).alias("start"), F.when(k % 5 != 0, F.add_months(day, 12)).alias("end"), F.when(k % 7 != 0, 1999).alias("snapshot"))
    return panel.impute_years(rows, "start", "end", "snapshot", 2001).select("o_orderkey", "start_year", "end_year")


_NEAR = {"monitoring": (("the", "der"), ("of", "und")), "scheduling": (("and",), ("to", "in")), "feedback": (("les", "la"), ("de", "et"))}


def _near_sql(a: tuple, b: tuple) -> str:
    x, y = "|".join(a), "|".join(b)
    return f"CAST(regexp_matches(regexp_replace(text, '\\s+', ' ', 'g'), '({x}).{{0,80}}({y})|({y}).{{0,80}}({x})') AS INT)"


@_query(f"""WITH f AS (SELECT doc_id, {", ".join(f"{_near_sql(a, b)} AS {n}" for n, (a, b) in _NEAR.items())}, CAST(regexp_matches(trim(regexp_replace(lower(concat_ws(' ', source, lang)), '[^a-z0-9]+', ' ', 'g')), 'web|news') AS INT) AS is_web FROM documents) SELECT *, greatest({", ".join(_NEAR)}) AS broad FROM f""")
def p12_proximity(spark: SparkSession, d: str) -> DataFrame:
    """Categories of words near each other in whole texts, the broad flag, a role flag on a normalised hierarchy."""
    t = _t(spark, d, "documents")
    flags = clean.proximity_flags(F.regexp_replace("text", r"\s+", " "), _NEAR) | clean.role_flags([F.col("source"), F.col("lang")], {"is_web": "web|news"})
    return t.select("doc_id", *(c.alias(n) for n, c in flags.items()))


@_query("SELECT l_suppkey, count(*) AS n, round(avg(l_quantity / l_tax), 4) AS mean FROM lineitem WHERE l_tax > 0 GROUP BY 1")
def p29_scrub(spark: SparkSession, d: str) -> DataFrame:
    """Null for NaN and infinities, then complete rows only."""
    ratio = F.when(F.col("l_tax") > 0, F.col("l_quantity") / F.col("l_tax")).otherwise(F.when(F.col("l_quantity") > 25, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
    rows = clean.scrub(_t(spark, d, "lineitem").withColumn("v", ratio), ["v"])
    return rows.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), r(F.avg("v")).alias("mean"))


@_query()
def s12_entity_sample(spark: SparkSession, d: str) -> DataFrame:
    """All rows of a stable tenth of the customers (a sampling operator; tested: each customer whole or absent)."""
    return io.entity_sample(_t(spark, d, "orders"), "o_custkey", 100)


@_query()
def s10_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes of a dataset, marks of finished and unfinished writes."""
    return io.file_inventory(spark, f"{d}/lineitem.parquet")


_SAMPLE = "SELECT * FROM orders ORDER BY md5('|' || o_orderkey), o_orderkey LIMIT 2000"
_SAMPLED = ("o_totalprice", "o_custkey", "o_orderkey")


@_query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM ({_SAMPLE})" for a in _SAMPLED for b in _SAMPLED))
def a29_sample_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Correlations on a sample of exactly 2000 rows, or all (a sampling operator), the same on each run."""
    rows = io.exact_sample(_t(spark, d, "orders"), ["o_orderkey"], 2000)
    return audit.correlations(rows, _SAMPLED, counts=True).withColumn("r", r("r", 6))


@_query("WITH k AS (SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY md5('|' || o_custkey), o_custkey LIMIT 60) SELECT o_orderkey, o_custkey, o_totalprice FROM orders SEMI JOIN k USING (o_custkey)")
def s12_exact_sample(spark: SparkSession, d: str) -> DataFrame:
    """All rows of exactly 60 customers (a sampling operator)."""
    return io.exact_entity_sample(_t(spark, d, "orders"), "o_custkey", 60).select("o_orderkey", "o_custkey", "o_totalprice")


@_query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('s|' || o_orderkey), o_orderkey) AS rn FROM orders) WHERE rn <= 20")
def w13_group_sample(spark: SparkSession, d: str) -> DataFrame:
    """Exactly 20 rows of each group by the least hashes of their key (a sampling operator)."""
    return io.exact_sample(_t(spark, d, "orders"), ["o_orderkey"], 20, ["o_orderpriority"], seed="s").select("o_orderpriority", "o_orderkey")


_CELLS = "SELECT 'parent' AS level, CAST(s_nationkey AS VARCHAR) AS key, l_orderkey, l_extendedprice FROM b UNION ALL SELECT 'year', CAST(year AS VARCHAR), l_orderkey, l_extendedprice FROM b UNION ALL SELECT 'all', 'all', l_orderkey, l_extendedprice FROM b"


@_query(f"""WITH b AS (SELECT s_nationkey, year(l_shipdate) AS year, l_orderkey, l_extendedprice FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), c AS ({_CELLS})
SELECT level, key, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders, true AS distinct_ok, true AS p10_ok, true AS p50_ok, true AS p90_ok FROM c GROUP BY level, key""")
def a23_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of firm-years merged to parents, years and all, held against exact counts and ranks: whether they keep their stated errors."""
    line = _t(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), "l_orderkey", "l_extendedprice")
    n_rows, supplier = line.count(), panel.small(_t(spark, d, "supplier").select("s_suppkey", "s_nationkey"))
    rows = lambda lines: lines.join(supplier, lines.l_suppkey == supplier.s_suppkey)

    def firm_years(large: DataFrame | None, how: str, whole: bool) -> DataFrame:
        lines = line if large is None else line.join(large, "l_suppkey", how)
        lines = panel.dealt(lines, "l_suppkey", n_rows) if whole else lines  # a large firm's sketches are merged from those of many tasks
        return sketches.sketch_panel(rows(lines), ["l_suppkey", "s_nationkey", "year"], {"orders": "l_orderkey"}, {"price": "l_extendedprice"})

    columns, deciles = {"parent": "s_nationkey", "year": "year"}, (10, 50, 90)
    levels = {n: F.col(c).cast("string") for n, c in columns.items()} | {"all": F.lit("all")}
    cells = F.array(*(F.struct(F.lit(n).alias("level"), c.alias("key")) for n, c in levels.items()))
    same = lambda a, b: (a["level"] == b["level"]) & a["key"].eqNullSafe(b["key"])
    with io.released(spark):
        fine = io.stable(panel.by_size(line.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")), "l_suppkey", firm_years))
        coarse = sketches.merge(fine.select("*", F.inline(cells)), ["level", "key"], ["orders"], ["price"])
        coarse = io.stable(sketches.estimates(coarse, ["orders"], {"price": [q / 100 for q in deciles]}).drop("n"))
        # prices are ranked in one pass over the finest cells of all levels, whose counts are then summed
        marks = fine.select(F.col("s_nationkey").alias("__parent"), F.col("year").alias("__year")).distinct()
        for level in levels:
            own = coarse.where(F.col("level") == level).select(F.col("key").alias("__key"), *(F.col(f"price_p{q}").alias(f"{level}{q}") for q in deciles))
            marks = marks.join(own, F.lit(True) if level == "all" else F.col(f"__{level}").cast("string").eqNullSafe(F.col("__key"))).drop("__key")
        x = F.nanvl("l_extendedprice", F.lit(None).cast("double"))
        sides = {"under": lambda c: x < F.col(c), "to": lambda c: x <= F.col(c)}
        counts = [F.count_if(side(f"{level}{q}")).alias(f"{n}_{level}{q}") for level in levels for q in deciles for n, side in sides.items()]
        ranked = rows(line).join(F.broadcast(marks), F.col("s_nationkey").eqNullSafe(F.col("__parent")) & F.col("year").eqNullSafe(F.col("__year")))
        ranked = ranked.groupBy("s_nationkey", "year").agg(F.count(F.lit(1)).alias("n"), F.count(x).alias("n_x"), *counts)
        own = [F.struct(F.lit(level).alias("level"), c.alias("key"), *(F.col(f"{n}_{level}{q}").alias(f"{n}{q}") for n in sides for q in deciles)) for level, c in levels.items()]
        ranks = ranked.select("n", "n_x", F.inline(F.array(*own))).groupBy("level", "key").agg(*(F.sum(c).alias(c) for c in ("n", "n_x", *(f"{n}{q}" for n in sides for q in deciles))))
        found = panel.distinct_by_level(rows(line), "l_orderkey", columns, n_rows).withColumnRenamed("n", "found")
        out = ranks.join(coarse, same(ranks, coarse)).join(found, same(ranks, found), "left").select(*(ranks[c] for c in ranks.columns), "orders", F.coalesce("found", F.lit(0).cast("long")).alias("n_orders"))
        # the ranks of a value reach from the share under it to the share up to it; a cell without prices has none to be wrong
        at, error = lambda c: F.try_divide(F.col(c), F.col("n_x")), F.try_divide(F.lit(1), F.col("n_x")) + sketches.RANK_ERROR
        near = [F.coalesce(F.lit(q / 100).between(at(f"under{q}") - error, at(f"to{q}") + error), F.lit(True)).alias(f"p{q}_ok") for q in deciles]
        out = out.select("level", "key", "n", "n_orders", (F.abs(F.col("orders") - F.col("n_orders")) <= sketches.DISTINCT_ERROR * F.col("n_orders") + 1).alias("distinct_ok"), *near)
        return io.stable(out, keep=True)


@_query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(CAST(o_orderdate AS DATE)) AS first_day FROM orders GROUP BY 1")
def s1_recursive_scan(spark: SparkSession, d: str) -> DataFrame:
    """A table written below folders of its own, read again with all folders below, dates by the old calendar's rules."""
    path = f"{io.shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    o = _t(spark, d, "orders")
    for status in ("F", "O", "P"):  # three folders
        io.write_parquet(o.where(F.col("o_orderstatus") == status).withColumn("day", F.to_date("o_orderdate")), f"{path}/{status.lower()}/x", 2)
    rows = io.read_parquet(spark, path, recursive=True, legacy_calendar=True)
    out = io.stable(rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"), F.min("day").alias("first_day")))
    io.delete(spark, path)
    return out


@_query("SELECT p_type, p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size, min(p_name) AS name FROM part GROUP BY ALL")
def s3_tsv(spark: SparkSession, d: str) -> DataFrame:
    """A table as tab-separated text with a header, read as strings, cast."""
    path = f"{io.shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    _t(spark, d, "part").select("p_type", "p_brand", "p_name", "p_size").write.option("sep", "\t").option("header", True).csv(path)
    rows = clean.cast_if_present(io.read_tsv(spark, path), "p_size", "int")
    out = io.stable(rows.groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"), F.min("p_name").alias("name")))
    io.delete(spark, path)
    return out


@_query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1")
def s5_csv(spark: SparkSession, d: str) -> DataFrame:
    """A summary as one CSV file, read back."""
    path = f"{io.shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    io.write_csv(_t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("o_totalprice"), 2).alias("mean")), path)
    out = io.stable(spark.read.option("header", True).schema("year int, n long, mean double").csv(path))
    io.delete(spark, path)
    return out


@_query("SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS customers, round(max(o_totalprice), 2) AS most FROM orders")
def s6_json_summary(spark: SparkSession, d: str) -> DataFrame:
    """A one-row summary as JSON, read back."""
    path = f"{io.shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    io.write_json_summary(_t(spark, d, "orders").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_custkey").alias("customers"), r(F.max("o_totalprice"), 2).alias("most")), path)
    out = io.stable(spark.read.schema("n_rows long, customers long, most double").json(path))
    io.delete(spark, path)
    return out


@_query("WITH t AS (SELECT * FROM (VALUES ('1-URGENT', 3), ('2-HIGH', 2), ('3-MEDIUM', 1)) t(o_orderpriority, weight)) SELECT o_orderstatus, CAST(sum(coalesce(weight, 0)) AS BIGINT) AS weight, count(weight) AS n FROM orders LEFT JOIN t USING (o_orderpriority) GROUP BY 1")
def s9_parameters(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary of the caller's as a table, joined to rows."""
    weights = io.parameter_table(spark, [("1-URGENT", 3), ("2-HIGH", 2), ("3-MEDIUM", 1)], "o_orderpriority string, weight int")
    rows = _t(spark, d, "orders").join(F.broadcast(weights), "o_orderpriority", "left")  # three rows
    return rows.groupBy("o_orderstatus").agg(F.sum(F.coalesce("weight", F.lit(0))).alias("weight"), F.count("weight").alias("n"))
