"""Registered queries of the panel operators over the driver's tables, each with SQL for the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import audit, clean, io, link, panel, regress
from .panel import Measure

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    from . import study_queries, wide_queries  # noqa: F401  they register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def _t(spark: SparkSession, d: str, table: str) -> DataFrame:
    return io.read_parquet(spark, f"{d}/{table}.parquet")


def r(c, n: int = 4):
    return F.round(c, n)


def _spells(spark: SparkSession, d: str) -> DataFrame:
    """Position spells: order date to ship date, repaired, with the supplier as firm and its nation as parent."""
    line, orders = _t(spark, d, "lineitem"), _t(spark, d, "orders")
    part, supplier = _t(spark, d, "part"), _t(spark, d, "supplier")
    rows = (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(part, line.l_partkey == part.p_partkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .select(
            F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("firm"), F.col("s_nationkey").alias("parent"), F.col("p_type").alias("role"),
            F.to_date("o_orderdate").alias("start"), F.to_date("l_shipdate").alias("end"), F.col("l_quantity").alias("w"), F.col("l_extendedprice").alias("salary"),
            F.nullif(F.round(F.col("l_tax") * 100), F.lit(0.0)).alias("x"), F.col("l_linenumber").alias("line"),
        )
    )
    return panel.repair_spell(rows, "start", "end").withColumns({"start_year": F.year("start"), "end_year": F.year("end")})


_SPELLS = """spells AS (
  SELECT o_custkey AS user_id, l_suppkey AS firm, s_nationkey AS parent, p_type AS role, CAST(o_orderdate AS DATE) AS "start",
         CAST(greatest(l_shipdate, o_orderdate) AS DATE) AS "end", l_quantity AS w, l_extendedprice AS salary, nullif(round(l_tax * 100), 0) AS x, l_linenumber AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
), yearly AS (
  SELECT *, CAST(unnest(generate_series(year("start"), year("end"))) AS INTEGER) AS year FROM spells
)"""
_FIRM = f"""WITH {_SPELLS}, firm_year AS (
  SELECT firm, parent, year, sum(w) AS workers, count(*) AS n_spells, count(DISTINCT user_id) AS n_users,
    sum(w * CAST(year = year("start") AS INT)) AS hires, sum(w * CAST(year = year("end") AS INT)) AS exits,
    sum(x * w) / nullif(sum(CASE WHEN x IS NOT NULL THEN w END), 0) AS x_observed, sum(x * w) / nullif(sum(w), 0) AS x_all, sum(salary * w) / nullif(sum(w), 0) AS pay
  FROM yearly GROUP BY ALL)"""


def _firm_year(spark: SparkSession, d: str) -> DataFrame:
    years = panel.expand_to_years(_spells(spark, d))
    years = years.withColumns({"hired": F.col("is_hire").cast("double"), "left": F.col("is_exit").cast("double"), "one": F.lit(1)})
    measures = [
        Measure("n_users", "user_id", "nunique"), Measure("hires", "hired", "wsum"), Measure("exits", "left", "wsum"),
        Measure("x_observed", "x"), Measure("x_all", "x", denom="all"), Measure("pay", "salary"), Measure("workers", "w", "sum"), Measure("n_spells", "one", "sum"),
    ]
    return panel.build_panel(years, ["firm", "parent", "year"], "w", measures)


@_query(f"""{_FIRM} SELECT firm, year, workers, n_spells, n_users, hires, exits, round(hires / nullif(workers, 0), 4) AS hire_rate,
  round(x_observed, 4) AS x_observed, round(x_all, 4) AS x_all, round(pay, 2) AS pay FROM firm_year""")
def a4_firm_year(spark: SparkSession, d: str) -> DataFrame:
    """Repaired spells to yearly rows to a weighted firm-year panel."""
    f = _firm_year(spark, d)
    return f.select("firm", "year", "workers", "n_spells", "n_users", "hires", "exits", r(clean.safe_divide(F.col("hires"), F.col("workers"))).alias("hire_rate"), r("x_observed").alias("x_observed"), r("x_all").alias("x_all"), r("pay", 2).alias("pay"))


@_query(f"""WITH {_SPELLS} SELECT firm, parent, year, count(*) AS n_spells, round(sum(w), 4) AS stock, round(sum(w * CAST(year = year("start") AS INT)), 4) AS hires, round(sum(w * CAST(year = year("end") AS INT)), 4) AS exits FROM yearly GROUP BY firm, parent, year""")
def a4_stock_sweep(spark: SparkSession, d: str) -> DataFrame:
    """G1, A4: spells, stock, hires and exits of firm-years by signed events at the spells' bounds."""
    out = panel.stocks(_spells(spark, d), ["firm", "parent"], "w")
    return out.withColumns({c: r(c) for c in ("stock", "hires", "exits")})


@_query(f"""{_FIRM} SELECT parent, year, sum(workers) AS workers, max(n_users) AS max_users, round(sum(x_observed * workers) / sum(CASE WHEN x_observed IS NOT NULL THEN workers END), 4) AS x_mean, count(*) AS n_firms,
  CAST(sum(workers) >= 100 AND count(*) >= 2 AS INT) AS in_sample FROM firm_year GROUP BY parent, year""")
def a12_parent_year(spark: SparkSession, d: str) -> DataFrame:
    """Firm-years rolled up to their parents, with a sample flag."""
    f = _firm_year(spark, d)
    out = f.groupBy("parent", "year").agg(F.sum("workers").alias("w_sum"), F.max("n_users").alias("max_users"), Measure("x", "x_observed").expression("workers").alias("x"), F.count(F.lit(1)).alias("n_firms"))
    return out.select("parent", "year", F.col("w_sum").alias("workers"), "max_users", r("x").alias("x_mean"), "n_firms", clean.flag((F.col("w_sum") >= 100) & (F.col("n_firms") >= 2)).alias("in_sample"))


@_query(f"""WITH {_SPELLS} SELECT parent, role, year, sum(w) AS workers, count(DISTINCT user_id) AS n_users, round(ln(1 + count(DISTINCT user_id)), 4) AS log_users,
  round(ln(greatest(sum(w), 1)), 4) AS log_workers, round(sum(x * w) / sum(CASE WHEN x IS NOT NULL THEN w END), 4) AS x_mean, round(ln(sum(salary * w) / sum(w)), 6) AS log_pay,
  round(sum(w * CAST(year = year("start") AS INT)) / sum(w), 4) AS hire_rate, round(sum(w * CAST(year = year("end") AS INT)) / sum(w), 4) AS exit_rate FROM yearly GROUP BY ALL""")
def a16_parent_occ_year(spark: SparkSession, d: str) -> DataFrame:
    """Parent x occupation x year cells of position spells, weighted, with hire and exit rates."""
    years = panel.expand_to_years(_spells(spark, d))
    measures = [Measure("workers", "w", "sum"), Measure("n_users", "user_id", "nunique"), Measure("x", "x"), Measure("pay_", "salary"), Measure("hires", "is_hire", "wsum"), Measure("exits", "is_exit", "wsum")]
    out = panel.build_panel(years, ["parent", "role", "year"], "w", measures)
    rate = lambda c: r(clean.safe_divide(F.col(c), F.col("workers")))
    return out.select(
        "parent", "role", "year", "workers", "n_users", r(clean.log1p_filled(F.col("n_users"))).alias("log_users"), r(clean.log_floor(F.col("workers"))).alias("log_workers"),
        r("x").alias("x_mean"), r(F.log("pay_"), 6).alias("log_pay"), rate("hires").alias("hire_rate"), rate("exits").alias("exit_rate"),
    )


@_query(f"""WITH {_SPELLS}, m AS (SELECT *, sum(x * w) OVER p / sum(w) OVER p AS mean FROM yearly WHERE x IS NOT NULL WINDOW p AS (PARTITION BY parent, year))
SELECT parent, year, round(sum(w * (x - mean) * (x - mean)) / sum(w), 4) AS v, round(sqrt(sum(w * (x - mean) * (x - mean)) / sum(w)), 4) AS v_sd FROM m GROUP BY parent, year""")
def a13_weighted_variance(spark: SparkSession, d: str) -> DataFrame:
    """Weighted variance and SD in each parent-year."""
    out = panel.weighted_variance(panel.expand_to_years(_spells(spark, d)), ["parent", "year"], "x", "w", "v")
    return out.select("parent", "year", r("v").alias("v"), r("v_sd").alias("v_sd"))


@_query("""WITH u AS (SELECT o_custkey AS user_id, sum(CAST(o_orderpriority LIKE '1%' AS INT)) AS a, sum(CAST(o_orderpriority LIKE '2%' AS INT)) AS b, sum(CAST(o_orderpriority LIKE '3%' AS INT)) AS c, count(*) AS n FROM orders GROUP BY 1)
SELECT user_id, round((a*a+b*b+c*c) / nullif(CAST((a+b+c)*(a+b+c) AS DOUBLE), 0), 4) AS hhi, CAST(coalesce((a*a+b*b+c*c) / nullif(CAST((a+b+c)*(a+b+c) AS DOUBLE), 0) >= 0.5, false) AS INT) AS specialist,
round(a/n*(1-a/n) + b/n*(1-b/n) + c/n*(1-c/n), 4) AS dispersion FROM u""")
def a15_concentration(spark: SparkSession, d: str) -> DataFrame:
    """Counts by domain, a row's Herfindahl index, bundle dispersion."""
    o = _t(spark, d, "orders")
    counts = [F.sum(clean.flag(F.col("o_orderpriority").startswith(k))).alias(n) for k, n in (("1", "a"), ("2", "b"), ("3", "c"))]
    u = o.groupBy(F.col("o_custkey").alias("user_id")).agg(*counts, F.count(F.lit(1)).alias("n"))
    hhi = panel.concentration([F.col(c) for c in "abc"])
    return u.select("user_id", r(hhi).alias("hhi"), clean.flag(hhi >= 0.5).alias("specialist"), r(panel.bundle_dispersion([F.col(c) / F.col("n") for c in "abc"])).alias("dispersion"))


_FIRST = """f AS (SELECT user_id, min(CASE WHEN event_type = 'click' THEN CAST(ts AS DATE) END) AS first_click, min(CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END) AS first_purchase FROM events GROUP BY user_id)"""


@_query(f"WITH {_FIRST} SELECT user_id, first_click, first_purchase, least(first_click, first_purchase) AS first_any FROM f WHERE first_click IS NOT NULL OR first_purchase IS NOT NULL")
def a7_first_events(spark: SparkSession, d: str) -> DataFrame:
    """First date of each kind of event, the earlier of two."""
    e = _t(spark, d, "events").withColumn("day", F.to_date("ts"))
    out = panel.first_events(e, "user_id", "day", {f"first_{k}": F.col("event_type") == k for k in ("click", "purchase")})
    return out.withColumn("first_any", F.least("first_click", "first_purchase"))


@_query(f"""WITH {_FIRST}, p AS (SELECT user_id, CAST(day(ts) AS INT) AS day, count(*) AS n FROM events GROUP BY ALL), a AS (SELECT p.*, CAST(day(first_purchase) AS INT) AS first_day FROM p LEFT JOIN f USING (user_id))
SELECT user_id, day, n, CAST(day - first_day AS INT) AS event_time, CAST(coalesce(day = first_day, false) AS INT) AS is_first_year, CAST(coalesce(day >= first_day, false) AS INT) AS adopted, CAST(first_day IS NOT NULL AS INT) AS ever_adopter FROM a""")
def w8_adoption(spark: SparkSession, d: str) -> DataFrame:
    """Event time and adoption flags in a user-day panel."""
    e = _t(spark, d, "events").withColumns({"day": F.dayofmonth("ts"), "date": F.to_date("ts")})
    first = panel.first_events(e, "user_id", "date", {"first": F.col("event_type") == "purchase"}).select("user_id", F.dayofmonth("first").alias("first_day"))
    cells = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n")).join(first, "user_id", "left")
    return panel.adoption(cells, "day", "first_day").drop("first_day")


@_query(f"""WITH {_SPELLS}, k AS (SELECT user_id, year, firm, w, salary, line, row_number() OVER (PARTITION BY user_id, year ORDER BY w DESC, "start" DESC NULLS LAST, firm, line, salary, role, "end") AS rn FROM yearly)
SELECT user_id, year, firm, w, salary FROM k WHERE rn = 1""")
def w1_primary_position(spark: SparkSession, d: str) -> DataFrame:
    """The primary spell of each user and year by a total order."""
    order = [panel.down(F.col("w")), panel.down(F.col("start"), date=True), *(F.col(c) for c in ("firm", "line", "salary", "role", "end"))]
    out = panel.least_record(panel.expand_to_years(_spells(spark, d)), ["user_id", "year"], order)
    return out.select("user_id", "year", "firm", "w", "salary")


@_query(f"""WITH {_SPELLS}, a AS (SELECT user_id, year, firm, sum(w) AS w, count(*) AS n FROM yearly GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, year ORDER BY w DESC, n DESC, firm) AS rn, count(*) OVER (PARTITION BY user_id, year) AS firms FROM a)
SELECT user_id, year, firm AS primary_firm, w, CAST(firms > 1 AS INT) AS multi_firm FROM k WHERE rn = 1""")
def w2_primary_firm(spark: SparkSession, d: str) -> DataFrame:
    """The primary firm of each user and year, and whether there were several."""
    a = panel.expand_to_years(_spells(spark, d)).groupBy("user_id", "year", "firm").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    out = panel.least_record(a, ["user_id", "year"], [panel.down(F.col("w")), panel.down(F.col("n")), F.col("firm")], {"firms": F.count(F.lit(1))})
    return out.select("user_id", "year", F.col("firm").alias("primary_firm"), "w", clean.flag(F.col("firms") > 1).alias("multi_firm"))


@_query(f"""{_FIRM}, s AS (SELECT firm, year, workers, lead(workers, 2) OVER p AS f2, lag(workers) OVER p AS l1, first(workers) OVER (PARTITION BY firm ORDER BY year RANGE BETWEEN 2 FOLLOWING AND 2 FOLLOWING) AS c2 FROM firm_year WINDOW p AS (PARTITION BY firm ORDER BY year))
SELECT firm, year, f2, l1, c2, round(CASE WHEN workers > 0 AND f2 > 0 THEN 100 * (ln(f2) - ln(workers)) END, 4) AS growth, 100 * (f2 - workers) AS diff FROM s""")
def w3_dynamics(spark: SparkSession, d: str) -> DataFrame:
    """Row and calendar leads, lags, log growth and differences."""
    f = _firm_year(spark, d).select("firm", "year", "workers")
    f = f.withColumns({"f2": panel.shifted("workers", ["firm"], "year", 2), "l1": panel.shifted("workers", ["firm"], "year", -1), "c2": panel.shifted("workers", ["firm"], "year", 2, calendar=True)})
    return f.select("firm", "year", "f2", "l1", "c2", r(panel.growth(F.col("workers"), F.col("f2"))).alias("growth"), (100 * (F.col("f2") - F.col("workers"))).alias("diff"))


@_query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority AS role, lead(o_orderpriority) OVER p AS next_role, lag(o_orderpriority) OVER p AS last_role, o_totalprice, lead(o_totalprice) OVER p AS next_price FROM orders WINDOW p AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, next_role, last_role, CAST(coalesce(next_role <> role, false) AS INT) AS moved, round(CASE WHEN next_price > 0 AND o_totalprice > 0 THEN 100 * (ln(next_price) - ln(o_totalprice)) END, 4) AS pay_growth FROM o""")
def w6_moves(spark: SparkSession, d: str) -> DataFrame:
    """Next and previous role, move flag, pay growth."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = _t(spark, d, "orders").withColumns({"next_role": F.lead("o_orderpriority").over(w), "last_role": F.lag("o_orderpriority").over(w), "next_price": F.lead("o_totalprice").over(w)})
    return o.select("o_orderkey", "next_role", "last_role", clean.flag(F.col("next_role") != F.col("o_orderpriority")).alias("moved"), r(panel.growth(F.col("o_totalprice"), F.col("next_price"))).alias("pay_growth"))


@_query("""SELECT c_custkey, regexp_replace(regexp_replace(lower(coalesce(c_name, 'missing')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
trim(regexp_replace(lower(concat_ws(' ', c_name, c_mktsegment)), '[^a-z0-9]+', ' ', 'g')) AS norm, CASE WHEN c_nationkey IS NOT NULL THEN 'parent_' || c_nationkey END AS key,
nullif(substr(regexp_replace(c_name, '[^0-9]', '', 'g'), 1, 3), '') AS prefix, CASE WHEN NOT regexp_matches(trim(c_mktsegment), '(?i)^(|none|null|nan|empty)$') THEN regexp_replace(trim(c_mktsegment), '\\s+', ' ', 'g') END AS segment,
greatest(coalesce(c_acctbal, 1.0), 0.0) AS weight, CAST(c_mktsegment = 'BUILDING' AS INT) AS is_building FROM customer""")
def p_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Text cleaning, slugs, keys, prefixes, weights."""
    c = _t(spark, d, "customer")
    return c.select(
        "c_custkey", clean.slug(F.col("c_name")).alias("slug"), clean.normalize_text(F.col("c_name"), F.col("c_mktsegment")).alias("norm"),
        clean.entity_key(F.col("c_nationkey"), F.col("c_name"), F.col("c_custkey")).alias("key"), clean.industry_prefix(F.col("c_name")).alias("prefix"),
        clean.nullify_blank(F.col("c_mktsegment")).alias("segment"), clean.weight(F.col("c_acctbal")).alias("weight"), clean.flag(F.col("c_mktsegment") == "BUILDING").alias("is_building"),
    )


@_query("""SELECT doc_id, CAST(regexp_matches(lower(text), '(^|[^a-z])(the|and)([^a-z]|$)') AS INT) AS english, CAST(regexp_matches(lower(text), '(^|[^a-z])(und|der)([^a-z]|$)') AS INT) AS german,
CAST(greatest(regexp_matches(lower(text), '(^|[^a-z])(the|and)([^a-z]|$)'), regexp_matches(lower(text), '(^|[^a-z])(und|der)([^a-z]|$)')) AS INT) AS any_flag, CAST(regexp_matches(regexp_replace(text, '\\s+', ' ', 'g'), '(the|of).{0,80}(worthless|trash)|(worthless|trash).{0,80}(the|of)') AS INT) AS near FROM documents""")
def p9_text_flags(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary flags, any-flag, proximity pattern over whole texts."""
    t = _t(spark, d, "documents")
    flags = clean.regex_flags(F.lower("text"), {"english": r"(^|[^a-z])(the|and)([^a-z]|$)", "german": r"(^|[^a-z])(und|der)([^a-z]|$)"})
    near = clean.flag(F.regexp_replace("text", r"\s+", " ").rlike(clean.near(["the", "of"], ["worthless", "trash"])))
    return t.select("doc_id", *(c.alias(n) for n, c in flags.items()), F.greatest(*flags.values()).alias("any_flag"), near.alias("near"))


@_query("""WITH f AS (SELECT lang, regexp_matches(text, 'trash') AS a, regexp_matches(text, 'the') AS b FROM documents), e AS (SELECT lang, 'trash' AS label FROM f WHERE a UNION ALL SELECT lang, 'the' FROM f WHERE b)
SELECT lang, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 4) AS share FROM e GROUP BY lang, label""")
def g2_label_shares(spark: SparkSession, d: str) -> DataFrame:
    """Multi-label explode, counts and shares of the group's total."""
    t = _t(spark, d, "documents").withColumns(clean.regex_flags(F.col("text"), {"trash": "trash", "the": "the"}))
    n = clean.explode_labels(t, ["trash", "the"], "label").groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", r(F.col("n") / F.sum("n").over(Window.partitionBy("lang"))))


@_query("""WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, count(CASE WHEN n > 1 THEN 1 END) AS duplicate_keys, CAST(sum(n - 1) AS BIGINT) AS excess_rows, max(CASE WHEN n > 1 THEN n END) AS max_dup, round(avg(CASE WHEN n > 1 THEN n END), 6) AS avg_dup FROM k""")
def d1_key_report(spark: SparkSession, d: str) -> DataFrame:
    return audit.key_report(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumn("avg_dup", r("avg_dup", 6))


@_query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, l_orderkey, l_linenumber LIMIT 25")
def d2_top_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The most repeated keys."""
    return audit.top_duplicates(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query("WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, l_orderkey, l_linenumber LIMIT 25) SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem SEMI JOIN k USING (l_orderkey, l_linenumber)")
def j11_duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the worst keys, by a semi join."""
    return audit.duplicate_rows(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


_ORDER_COLUMNS = (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", None), ("o_orderpriority", "string"))


@_query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {f"'{t}'" if t else 'NULL'} AS dtype, count(*) - count({c}) AS n_null, (count(*) - count({c})) / count(*) AS null_share, count(DISTINCT {c}) AS n_distinct FROM orders" for c, t in _ORDER_COLUMNS))
def d3_column_profile(spark: SparkSession, d: str) -> DataFrame:
    """Nulls and distinct values of all columns; the type of a date column, which files may give in two ways, is left out."""
    out = audit.column_profile(_t(spark, d, "orders"), exact=True)
    return out.withColumn("dtype", F.when(~F.col("dtype").startswith("timestamp"), F.col("dtype")))


@_query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_tax")))
def d4_numeric_profile(spark: SparkSession, d: str) -> DataFrame:
    """Min, max, mean, SD of numeric columns in one pass."""
    p = audit.numeric_profile(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return p.withColumns({"mean": r("mean"), "sd": r("sd")})


@_query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_entities FROM orders GROUP BY 1")
def d5_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Rows and entities by year."""
    return audit.by_year(_t(spark, d, "orders").withColumn("year", F.year("o_orderdate")), "year", "o_custkey")


@_query("WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT min(n) AS min, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.99) AS p99, max(n) AS max FROM n")
def d6_rows_per_entity(spark: SparkSession, d: str) -> DataFrame:
    return audit.rows_per_entity(_t(spark, d, "orders"), "o_custkey")


@_query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def d7_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Two-way counts."""
    return audit.crosstab(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@_query("SELECT count(*) > 0 AS has_rows, 11 AS n_columns, count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS key_ok FROM lineitem")
def d8_status(spark: SparkSession, d: str) -> DataFrame:
    return audit.status(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query("SELECT true AS files_ok, count(*) > 0 AS has_rows, 3 AS n_columns, count(*) = count(DISTINCT (o_custkey, year(o_orderdate))) AS key_ok FROM (SELECT o_custkey, any_value(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey, year(o_orderdate))")
def d8_table_status(spark: SparkSession, d: str) -> DataFrame:
    """A panel written with its manifest, read back and held against it: files, rows, columns, key."""
    panel_ = _t(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    path = f"{io.shared_folder(spark)}/verified/{uuid.uuid4().hex}"
    io.write_verified(panel_, path, ["o_custkey", "year"])
    out = io.stable(audit.table_status(spark, path, ["o_custkey", "year"]))
    io.delete(spark, path)
    return out


@_query(f"WITH {_FIRST} SELECT first_purchase AS day, count(*) AS adopters FROM f WHERE first_purchase IS NOT NULL GROUP BY 1")
def d11_adoption_counts(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").withColumn("day", F.to_date("ts"))
    first = panel.first_events(e, "user_id", "day", {"first": F.col("event_type") == "purchase"})
    return first.groupBy(F.col("first").alias("day")).agg(F.count(F.lit(1)).alias("adopters"))


@_query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in ("l_quantity", "l_tax", "l_extendedprice") for b in ("l_quantity", "l_tax", "l_extendedprice")))
def a29_correlations(spark: SparkSession, d: str) -> DataFrame:
    c = audit.correlations(_t(spark, d, "lineitem"), ["l_quantity", "l_tax", "l_extendedprice"])
    return c.withColumn("r", F.round("r", 6))


@_query("WITH v AS (SELECT l_quantity / 40.0 AS v FROM lineitem), b AS (SELECT round(CASE WHEN v >= 1 THEN 0.9 ELSE floor(v / 0.1) * 0.1 END, 6) AS bin_left FROM v) SELECT bin_left, count(*) AS n, round(bin_left + 0.1, 6) AS bin_right FROM b GROUP BY bin_left")
def a30_histogram(spark: SparkSession, d: str) -> DataFrame:
    return audit.histogram(_t(spark, d, "lineitem").withColumn("v", F.col("l_quantity") / 40.0), "v", 0.1)


@_query("SELECT greatest((SELECT max(year(l_shipdate)) FROM lineitem), (SELECT max(year(o_orderdate)) FROM orders), 1950)::INT AS horizon")
def a11_horizon(spark: SparkSession, d: str) -> DataFrame:
    """Latest year over several sources, with a fallback."""
    years = [_t(spark, d, t).agg(F.max(F.year(c)).alias("y")) for t, c in (("lineitem", "l_shipdate"), ("orders", "o_orderdate"))]
    return years[0].unionByName(years[1]).agg(F.greatest(F.max("y"), F.lit(1950)).alias("horizon"))


@_query("SELECT o_custkey AS user_id, CAST(count(*) AS BIGINT) AS n, max(CASE WHEN o_orderpriority LIKE '1%' THEN 5 WHEN o_orderpriority LIKE '2%' THEN 4 END) AS best, min(o_totalprice) AS least, CAST(max(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS INT) AS any_first, count(DISTINCT o_orderstatus) AS n_status FROM orders GROUP BY 1")
def a8_user_features(spark: SparkSession, d: str) -> DataFrame:
    """Counts, best score and flags of a user's rows."""
    p = F.col("o_orderpriority")
    score = F.when(p.startswith("1"), 5).when(p.startswith("2"), 4)
    return _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("n"), F.max(score).alias("best"), F.min("o_totalprice").alias("least"), F.max(clean.flag(p.startswith("1"))).alias("any_first"), F.count_distinct("o_orderstatus").alias("n_status"))


@_query("WITH a AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1), b AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1), c AS (SELECT c_nationkey AS k, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT k AS nation, n_name, suppliers, customers, n_orders, greatest(coalesce(customers, 0) - 1, 0) AS peers FROM a FULL JOIN b USING (k) FULL JOIN c USING (k) LEFT JOIN nation ON n_nationkey = k")
def j3_outer_panels(spark: SparkSession, d: str) -> DataFrame:
    """Full outer joins of three panels, a static lookup, derived peers."""
    count = lambda df, k, out: df.groupBy(F.col(k).alias("k")).agg(F.count(F.lit(1)).alias(out))
    customer, orders = _t(spark, d, "customer"), _t(spark, d, "orders")
    ordered = orders.join(customer, orders.o_custkey == customer.c_custkey)
    frames = [count(_t(spark, d, "supplier"), "s_nationkey", "suppliers"), count(customer, "c_nationkey", "customers"), count(ordered, "c_nationkey", "n_orders")]
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    out = panel.outer_join_all(frames, ["k"]).join(n, "k", "left")
    return out.select(F.col("k").alias("nation"), "n_name", "suppliers", "customers", "n_orders", F.greatest(F.coalesce("customers", F.lit(0)) - 1, F.lit(0)).alias("peers"))


@_query("SELECT p_partkey, p_type, round(p_size / sum(p_size) OVER (PARTITION BY p_type), 8) AS omega FROM part")
def a21_task_weights(spark: SparkSession, d: str) -> DataFrame:
    """A rating's share within its occupation."""
    return link.task_weights(_t(spark, d, "part"), "p_type", "p_size").select("p_partkey", "p_type", r("omega", 8).alias("omega"))


@_query("WITH b AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem), w AS (SELECT l_returnflag, least(greatest(l_extendedprice, lo), hi) AS y FROM lineitem, b) SELECT l_returnflag, round(avg(y), 2) AS mean, round(min(y), 2) AS low, round(max(y), 2) AS high FROM w GROUP BY 1")
def r4_winsorise(spark: SparkSession, d: str) -> DataFrame:
    w = regress.winsorise(_t(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice")
    return w.groupBy("l_returnflag").agg(r(F.avg("l_extendedprice"), 2).alias("mean"), r(F.min("l_extendedprice"), 2).alias("low"), r(F.max("l_extendedprice"), 2).alias("high"))


@_query("""WITH e AS (SELECT CAST(date_diff('year', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INT) AS event_time, l_extendedprice AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT event_time, round(avg(y), 2) AS mean, round(stddev_samp(y) / sqrt(count(*)), 2) AS se, count(*) AS n FROM e GROUP BY 1""")
def r9_event_path(spark: SparkSession, d: str) -> DataFrame:
    """Mean path by event time with standard errors."""
    line, o = _t(spark, d, "lineitem"), _t(spark, d, "orders")
    e = line.join(o, line.l_orderkey == o.o_orderkey).withColumn("event_time", F.year("l_shipdate") - F.year("o_orderdate"))
    return regress.event_path(e, "event_time", "l_extendedprice").select("event_time", r("mean", 2).alias("mean"), r("se", 2).alias("se"), "n")


@_query("WITH n AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1 HAVING count(*) >= 8 AND avg(o_totalprice) >= 100000) SELECT o_orderkey, o_custkey FROM orders SEMI JOIN n USING (o_custkey)")
def r12_entity_filter(spark: SparkSession, d: str) -> DataFrame:
    """Entities with enough rows and size, by a semi join."""
    o = _t(spark, d, "orders")
    kept = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m")).where("n >= 8 and m >= 100000")
    return o.join(kept, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@_query("SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS n_flagged FROM orders")
def s11_readback(spark: SparkSession, d: str) -> DataFrame:
    """Rows, keys and flagged rows in one pass."""
    return io.readback_counts(_t(spark, d, "orders").withColumn("f", clean.flag(F.col("o_totalprice") > 100000)), ["o_orderkey"], "f")
