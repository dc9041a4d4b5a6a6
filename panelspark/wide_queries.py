"""Registered queries of wide panels, feature tables, their joins, exposure chains and linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import clean, link, panel
from .io import released, stable
from .panel import Measure
from .queries import _query, _t, r

_PRIORITIES, _FLAGS, _STATES = "12345", "ANR", "FO"

#: Measures of the wide panels: name, column, how, denominator, digits ("ln" for means of money, which are given as logs:
#: a rounded mean of cents can lie right between two values).
_NUMBERS = [(f"{c}_{d}", c, "wmean", d, n) for c, n in (("x", 4), ("disc", 4), ("size", 4), ("salary", "ln"), ("price", "ln"), ("bal", "ln"), ("total", "ln")) for d in ("observed", "all")]
_SHARES = [(f"{p}_{k.lower()}_share", f"{p}_{k.lower()}", "wmean", "all", 4) for p, ks in (("prio", _PRIORITIES), ("flag", _FLAGS), ("state", _STATES)) for k in ks]
_FIRM_MEASURES = [
    *_NUMBERS, *_SHARES, ("workers", "w", "sum", "", 2), ("n_rows", "one", "sum", "", 0),
    *((f"{n}_w", n, "wsum", "", 2) for n in ("hires", "exits", "censored", "is_new", "is_large")),
    *((f"{n}_{c}", c, n, "", 2) for c in ("size", "salary", "price") for n in ("min", "max")), *((f"avg_{c}", c, "avg", "", 2) for c in ("size", "x", "disc", "w")),
    *((f"n_{c}", c, "nunique", "", 0) for c in ("user_id", "job", "brand", "role", "segment", "home", "prio")),
    ("firm_name", "name", "first", "", None), ("first_brand", "brand", "first", "", None), ("first_segment", "segment", "first", "", None),
]
_USER_MEASURES = [*_NUMBERS, *_SHARES, ("workers", "w", "sum", "", 2), ("n_firms", "firm", "nunique", "", 0), ("n_parents", "parent", "nunique", "", 0), ("n_states", "state", "nunique", "", 0), ("hires_w", "hires", "wsum", "", 2), ("exits_w", "exits", "wsum", "", 2)]

_WIDE = f"""wide AS (
  SELECT o_custkey AS user_id, l_suppkey AS firm, s_nationkey AS parent, s_name AS name, p_type AS role, p_brand AS brand, c_mktsegment AS segment, c_nationkey AS home,
    l_orderkey * 100 + l_linenumber AS job, substr(o_orderpriority, 1, 1) AS prio, l_returnflag AS rflag, l_linestatus AS state,
    CAST(o_orderdate AS DATE) AS "start", CAST(greatest(l_shipdate, o_orderdate) AS DATE) AS "end", l_quantity AS w, l_extendedprice AS salary, nullif(round(l_tax * 100), 0) AS x,
    nullif(round(l_discount * 100), 0) AS disc, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, c_acctbal + 1000 AS bal, o_totalprice AS total, 1 AS one
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
), years AS (
  SELECT *, CAST(unnest(generate_series(year("start"), year("end"))) AS INTEGER) AS year FROM wide
), flagged AS (
  SELECT *, CAST(year = year("start") AS INT) AS hires, CAST(year = year("end") AS INT) AS exits, 0 AS censored, CAST(year("end") - year("start") = 0 AS INT) AS is_new, CAST(w > 25 AS INT) AS is_large,
    {", ".join(f"CAST(prio = '{k}' AS INT) AS prio_{k}" for k in _PRIORITIES)}, {", ".join(f"CAST(rflag = '{k}' AS INT) AS flag_{k.lower()}" for k in _FLAGS)},
    {", ".join(f"CAST(state = '{k}' AS INT) AS state_{k.lower()}" for k in _STATES)} FROM years
)"""


def _measure_sql(name: str, c: str, how: str, denom: str, digits: int | str | None) -> str:
    if how == "wmean":
        e = f"sum({c} * w) / nullif(sum({f'CASE WHEN {c} IS NOT NULL THEN w END' if denom == 'observed' else 'w'}), 0)"
    else:
        e = {"wsum": f"sum({c} * w)", "nunique": f"count(DISTINCT {c})", "first": f"min({c})"}.get(how, f"{how}({c})")
    if digits == "ln":
        return f"round(ln({e}), 6) AS {name}"
    return f"{e if how in ('nunique', 'first') or name == 'n_rows' else f'round({e}, {digits})'} AS {name}"


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customer, before any line is joined: lines are not dealt by customer for it."""
    orders, customer = _t(spark, d, "orders"), _t(spark, d, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey)


def _kept(line: DataFrame, key: str, large: DataFrame | None, how: str) -> DataFrame:
    return line if large is None else line.join(large, key, how)


def _firm_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Lines by firm; all their years are at most a few times as many rows."""
    return _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


def _user_sizes(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("o_custkey").agg(F.sum("n").alias("n"))


def _flagged(spark: SparkSession, d: str, by: str | None = None, large: DataFrame | None = None, how: str = "") -> DataFrame:
    """Yearly position rows with all attributes and 0/1 columns; with ``by`` (``l_suppkey``, ``o_custkey``) dealt by it, without or with ``large`` ones alone."""
    line, part, ordered = _t(spark, d, "lineitem"), _t(spark, d, "part"), _ordered(spark, d)
    n, supplier = line.count(), panel.small(_t(spark, d, "supplier"))
    line, ordered = (_kept(line, by, large, how), ordered) if by == "l_suppkey" else (line, _kept(ordered, by, large, how))
    rows = line.join(part, line.l_partkey == part.p_partkey).join(ordered, line.l_orderkey == ordered.o_orderkey)
    rows = panel.dealt(rows, by, n) if by else rows
    rows = rows.join(supplier, line.l_suppkey == supplier.s_suppkey)
    tenths = lambda c: F.nullif(F.round(F.col(c) * 100), F.lit(0.0))
    rows = rows.select(
        F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("firm"), F.col("s_nationkey").alias("parent"), F.col("s_name").alias("name"), F.col("p_type").alias("role"),
        F.col("p_brand").alias("brand"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("home"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("job"),
        F.substring("o_orderpriority", 1, 1).alias("prio"), F.col("l_returnflag").alias("rflag"), F.col("l_linestatus").alias("state"), F.to_date("o_orderdate").alias("start"),
        F.to_date("l_shipdate").alias("end"), F.col("l_quantity").alias("w"), F.col("l_extendedprice").alias("salary"), tenths("l_tax").alias("x"), tenths("l_discount").alias("disc"),
        F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), (F.col("c_acctbal") + 1000).alias("bal"), F.col("o_totalprice").alias("total"), F.lit(1).alias("one"),
    )
    rows = panel.repair_spell(rows, "start", "end").withColumns({"start_year": F.year("start"), "end_year": F.year("end")})
    years = panel.expand_to_years(rows, "start", "end").withColumnsRenamed({"is_hire": "hires", "is_exit": "exits", "is_censored": "censored"})
    hot = clean.one_hot(F.col("prio"), _PRIORITIES, "prio_") | clean.one_hot(F.col("rflag"), _FLAGS, "flag_") | clean.one_hot(F.col("state"), _STATES, "state_")
    return years.withColumns(hot | {"is_new": clean.flag(F.col("start_year") == F.col("end_year")), "is_large": clean.flag(F.col("w") > 25)})


def _panel(df: DataFrame, keys: list[str], spec: list[tuple], whole: bool = False) -> DataFrame:
    out = panel.build_panel(df, keys, "w", [Measure(n, c, how, denom or "observed") for n, c, how, denom, _ in spec], whole)
    return out.withColumns({n: r(F.log(n), 6) if k == "ln" else r(n, k) for n, _, how, _, k in spec if how not in ("nunique", "first") and n != "n_rows"})


@_query(f"""WITH {_WIDE}, p AS (SELECT firm, year, {", ".join(_measure_sql(*m) for m in _FIRM_MEASURES)} FROM flagged GROUP BY firm, year)
SELECT *, round(hires_w / nullif(workers, 0), 4) AS hire_rate, round(exits_w / nullif(workers, 0), 4) AS exit_rate, round(is_new_w / nullif(workers, 0), 4) AS new_rate FROM p""")
def a4_firm_year_wide(spark: SparkSession, d: str) -> DataFrame:
    """The wide firm-year panel, 55 measures and three rates in one aggregate."""
    rows = lambda large, how, whole: _flagged(spark, d, "l_suppkey", large, how)
    out = panel.by_size(_firm_sizes(spark, d), "l_suppkey", lambda *a: _panel(rows(*a), ["firm", "year"], _FIRM_MEASURES, a[2]))
    rates = {"hire_rate": "hires_w", "exit_rate": "exits_w", "new_rate": "is_new_w"}
    return out.withColumns({n: r(clean.safe_divide(F.col(c), F.col("workers"))) for n, c in rates.items()})


@_query(f"WITH {_WIDE} SELECT user_id, year, {', '.join(_measure_sql(*m) for m in _USER_MEASURES)} FROM flagged GROUP BY user_id, year")
def a6_worker_year(spark: SparkSession, d: str) -> DataFrame:
    """A worker-year's portfolio of positions, weighted, with distinct firms, parents and places."""
    rows = lambda large, how, whole: _flagged(spark, d, "o_custkey", large, how)
    return panel.by_size(_user_sizes(spark, d), "o_custkey", lambda *a: _panel(rows(*a), ["user_id", "year"], _USER_MEASURES, a[2]))


_STUDY, _ENRICHED = "(?i)ring|econ", "(?i)ring|small|econ|brand#2"
_POSTS = f"""posts AS (
  SELECT l_orderkey * 100 + l_linenumber AS job_id, l_suppkey AS firm, s_name AS firm_name, s_nationkey AS parent, n_regionkey AS industry, p_type AS occ, p_brand AS mapped_role, o_orderpriority AS category,
    CAST(o_orderdate AS DATE) AS post_date, CAST(year(o_orderdate) AS INT) AS year, CASE WHEN l_shipdate >= o_orderdate THEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) END AS days,
    CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS salary, l_linestatus AS state, c_mktsegment AS city,
    {", ".join(f"CAST(regexp_matches({c}, '{p}') AS INT) AS {t}_{n}" for n, p in (("study", _STUDY), ("enriched", _ENRICHED)) for t, c in (("title", "p_name"), ("description", "p_brand || ' ' || p_type")))}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey JOIN nation ON s_nationkey = n_nationkey
), posting AS (SELECT *, greatest(title_study, description_study) AS any_study, greatest(title_enriched, description_enriched) AS any_enriched FROM posts)"""
_KINDS = [f"{t}_{n}" for n in ("study", "enriched") for t in ("title", "description", "any")]


def _postings(spark: SparkSession, d: str, by: str | None = None, large: DataFrame | None = None, how: str = "") -> DataFrame:
    """Postings with text flags: order date to ship date, the supplier as firm, its nation as parent, its region as industry.

    Texts are flagged once a part, not once a posting. ``by``: as for ``_flagged``.
    """
    line, part, ordered = _t(spark, d, "lineitem"), _t(spark, d, "part"), _ordered(spark, d)
    supplier, nation = _t(spark, d, "supplier"), _t(spark, d, "nation")
    flags = clean.text_flags({"title": F.col("p_name"), "description": F.concat_ws(" ", "p_brand", "p_type")}, {"study": _STUDY, "enriched": _ENRICHED})
    part = part.select("p_partkey", "p_brand", "p_type", *(c.alias(n) for n, c in flags.items()))
    rows = (line if by is None else _kept(line, by, large, how)).join(part, line.l_partkey == part.p_partkey).join(ordered, line.l_orderkey == ordered.o_orderkey)
    rows = panel.dealt(rows, by, line.count()) if by else rows
    rows = rows.join(panel.small(supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)), line.l_suppkey == supplier.s_suppkey)
    return rows.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("job_id"), F.col("l_suppkey").alias("firm"), F.col("s_name").alias("firm_name"), F.col("s_nationkey").alias("parent"),
        F.col("n_regionkey").alias("industry"), F.col("p_type").alias("occ"), F.col("p_brand").alias("mapped_role"), F.col("o_orderpriority").alias("category"), F.to_date("o_orderdate").alias("post_date"),
        F.year("o_orderdate").alias("year"), clean.duration_days(F.to_date("o_orderdate"), F.to_date("l_shipdate")).alias("days"), F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")).alias("salary"),
        F.col("l_linestatus").alias("state"), F.col("c_mktsegment").alias("city"), *flags,
    )


@_query(f"""WITH {_POSTS}, p AS (SELECT firm, year, min(firm_name) AS firm_name, min(parent) AS parent, count(*) AS posting_count, count(salary) AS with_salary, round(ln(avg(salary)), 6) AS log_pay, round(avg(days), 4) AS days,
  count(DISTINCT state) AS n_states, count(DISTINCT city) AS n_cities, count(DISTINCT category) AS n_categories, count(DISTINCT mapped_role) AS n_roles, count(DISTINCT occ) AS n_occ, min(post_date) AS first_post,
  {", ".join(f"CAST(sum({k}) AS BIGINT) AS {k}" for k in _KINDS)}, {", ".join(f"round(avg(CAST(category LIKE '{k}%' AS INT)), 4) AS cat_{k}_share" for k in _PRIORITIES)} FROM posting GROUP BY firm, year),
f AS (SELECT firm, {", ".join(f"min(CASE WHEN {k} = 1 THEN post_date END) AS first_{k}" for k in _KINDS)} FROM posting GROUP BY firm)
SELECT p.*, round(with_salary / posting_count, 4) AS coverage, {", ".join(f"round({k} / posting_count, 4) AS {k}_share" for k in _KINDS)}, f.* EXCLUDE (firm) FROM p LEFT JOIN f USING (firm)""")
def a5_posting_firm_year(spark: SparkSession, d: str) -> DataFrame:
    """Postings by firm and year: counts, means, distinct values, shares, and the firm's first flagged dates."""
    one = Measure
    shares = {f"cat_{k}_share": clean.flag(F.col("category").startswith(k)) for k in _PRIORITIES}
    dates = {f"first_{k}": F.when(F.col(k) == 1, F.col("post_date")) for k in _KINDS}
    extra = shares | dates | {"one": F.lit(1), "has_salary": clean.flag(F.col("salary").isNotNull())}
    measures = [
        one("firm_name", "firm_name", "first"), one("parent", "parent", "first"), one("posting_count", "one", "sum"), one("with_salary", "has_salary", "sum"), one("log_pay", "salary", "avg"), one("days", "days", "avg"),
        *(one(n, c, "nunique") for n, c in (("n_states", "state"), ("n_cities", "city"), ("n_categories", "category"), ("n_roles", "mapped_role"), ("n_occ", "occ"))),
        one("first_post", "post_date", "min"), *(one(k, k, "sum") for k in _KINDS), *(one(k, k, "avg") for k in shares), *(one(k, k, "min") for k in dates),
    ]

    def make(large: DataFrame | None, how: str, whole: bool) -> DataFrame:
        out = panel.build_panel(_postings(spark, d, "l_suppkey", large, how).withColumns(extra), ["firm", "year"], "one", measures, whole)
        return out.withColumns({k: F.min(k).over(Window.partitionBy("firm")) for k in dates})  # a row a year

    out = panel.by_size(_firm_sizes(spark, d), "l_suppkey", make)
    out = out.withColumns({"log_pay": r(clean.log_positive(F.col("log_pay")), 6), "days": r("days")} | {k: r(k) for k in shares})
    return out.withColumns({"coverage": r(F.col("with_salary") / F.col("posting_count"))} | {f"{k}_share": r(clean.safe_divide(F.col(k), F.col("posting_count"))) for k in _KINDS})


@_query(f"WITH {_POSTS} SELECT job_id, firm, firm_name, parent, post_date, mapped_role, category, {', '.join(_KINDS)} FROM posting WHERE any_enriched = 1")
def w12_detail_listing(spark: SparkSession, d: str) -> DataFrame:
    """The flagged postings in order of firm and date."""
    from .audit import flagged_rows

    wanted = ["job_id", "firm", "firm_name", "parent", "post_date", "title_raw", "mapped_role", "category", *_KINDS]
    return flagged_rows(_postings(spark, d), "any_enriched", wanted, ["firm_name", "post_date", "job_id"])


@_query(f"""WITH {_POSTS}, p AS (SELECT parent, occ, year, count(DISTINCT job_id) AS posting_count, CAST(sum(any_enriched) AS BIGINT) AS pa_count, round(avg(any_enriched), 4) AS pa_share, round(ln(avg(salary)), 6) AS log_pay,
  round(avg(CAST(salary IS NOT NULL AS INT)), 4) AS coverage, round(avg(days), 4) AS days, count(DISTINCT category) AS n_categories, count(DISTINCT city) AS n_cities, min(firm_name) AS first_firm, min(industry) AS industry FROM posting GROUP BY parent, occ, year),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent, year ORDER BY n_posts DESC, firm) AS rn FROM (SELECT parent, year, firm, count(*) AS n_posts, round(avg(any_study), 4) AS study_share FROM posting GROUP BY parent, year, firm)) WHERE rn = 1)
SELECT p.*, round(ln(1 + posting_count), 4) AS log_count, round(ln(1 + pa_count), 4) AS log_pa_count, round(sqrt(posting_count), 4) AS root_count, n_posts AS ctx_n_posts, study_share AS ctx_study_share,
  CAST(pa_count > 0 AND posting_count >= 3 AND industry IS NOT NULL AS INT) AS in_sample FROM p LEFT JOIN c USING (parent, year)""")
def a17_posting_parent_occ_year(spark: SparkSession, d: str) -> DataFrame:
    """Postings by parent, occupation and year, with the context of their parent-year's largest firm, and a sample flag."""
    spec = [("posting_count", "job_id", "nunique"), ("pa_count", "any_enriched", "sum"), ("pa_share", "any_enriched", "avg"), ("log_pay", "salary", "avg"), ("coverage", "has_salary", "avg"), ("days", "days", "avg")]
    spec += [("n_categories", "category", "nunique"), ("n_cities", "city", "nunique"), ("first_firm", "firm_name", "first"), ("industry", "industry", "first")]
    with released(spark):  # the joined postings are read three times
        posts = _postings(spark, d).withColumns({"one": F.lit(1), "has_salary": clean.flag(F.col("salary").isNotNull())})
        posts = stable(posts.select("parent", "occ", "year", "firm", "one", "any_study", *dict.fromkeys(c for _, c, _ in spec)))
        out = panel.build_panel(posts, ["parent", "occ", "year"], "one", [Measure(*m) for m in spec])
        out = out.withColumns({"pa_share": r("pa_share"), "log_pay": r(clean.log_positive(F.col("log_pay")), 6), "coverage": r("coverage"), "days": r("days")})
        logs = {"log_count": r(clean.log1p_filled(F.col("posting_count"))), "log_pa_count": r(clean.log1p_filled(F.col("pa_count"))), "root_count": r(clean.root(F.col("posting_count")))}
        firms = posts.groupBy("parent", "year", "firm").agg(F.count(F.lit(1)).alias("n_posts"), r(F.avg("any_study")).alias("study_share"))  # several a parent and year
        out = panel.attach(out.withColumns(logs), firms, ["parent", "year"], "ctx_", [F.desc("n_posts"), F.col("firm")]).drop("ctx_firm")
        return stable(out.withColumn("in_sample", clean.in_sample(F.col("pa_count"), F.col("posting_count"), 3, F.col("industry"))), keep=True)


_DEGREES = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Doctor of Arts' WHEN '2' THEN 'MBA' WHEN '3' THEN 'Bachelor' WHEN '4' THEN 'Associate' END"
_EDUCATION = f"""edu AS (SELECT o_custkey AS user_id, {_DEGREES} AS degree, o_totalprice / 500 AS world, CAST(o_orderkey % 700 AS DOUBLE) AS us FROM orders),
scored AS (SELECT *, CASE degree WHEN 'Doctor of Arts' THEN 5 WHEN 'MBA' THEN 4 WHEN 'Bachelor' THEN 3 WHEN 'Associate' THEN 2 END AS score FROM edu),
education AS (SELECT user_id, count(*) AS education_records, max(score) AS best_degree, round(min(world), 4) AS best_world_rank, min(us) AS best_us_rank, CAST(max(CAST(coalesce(world <= 500, false) OR coalesce(us <= 100, false) AS INT)) AS INT) AS has_top_school,
  CAST(max(CAST(coalesce(score >= 3, false) AS INT)) AS INT) AS has_bachelor, CAST(max(CAST(coalesce(score >= 4, false) AS INT)) AS INT) AS has_master FROM scored GROUP BY user_id)"""


def _education(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").withColumnsRenamed({"o_custkey": "user_id"})
    names = {"1": "Doctor of Arts", "2": "MBA", "3": "Bachelor", "4": "Associate"}
    first = F.substring("o_orderpriority", 1, 1)
    degree = F.coalesce(*(F.when(first == k, F.lit(v)) for k, v in names.items()))
    rows = o.withColumns({"degree": degree, "world": (F.col("o_totalprice") / 500).cast("string"), "us": F.col("o_orderkey") % 700})
    rows = clean.cast_if_present(clean.cast_if_present(clean.clean_text_columns(rows, ["degree", "degree_raw"]), "world", "double"), "us", "double")
    rows = rows.withColumns(clean.rank_flags(clean.degree_score(F.col("degree")), F.col("world"), F.col("us")))
    top = lambda c: F.max(c).alias(c)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("education_records"), top("best_degree"), r(F.min("world")).alias("best_world_rank"), F.min("us").alias("best_us_rank"), top("has_top_school"), top("has_bachelor"), top("has_master"))


@_query(f"WITH {_EDUCATION} SELECT * FROM education")
def a8_education_features(spark: SparkSession, d: str) -> DataFrame:
    """Records, best degree and ranks, and flags of each user's education rows."""
    return _education(spark, d)


_SKILL_WORDS = {"metal_skill": "ring|bolt", "small_skill": "small", "blue_skill": "blue|red"}
_SKILLS = f"""raw AS (SELECT o_custkey AS user_id, coalesce(nullif(trim(p_name), ''), p_brand) AS skill, CAST(p_size > 25 AS DOUBLE) AS predicted, p_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
one AS (SELECT *, row_number() OVER (PARTITION BY user_id, skill ORDER BY p_partkey) AS rn FROM raw WHERE skill IS NOT NULL),
skills AS (SELECT user_id, count(DISTINCT skill) AS distinct_skills, round(avg(predicted), 4) AS predicted_share, {", ".join(f"CAST(max(CAST(regexp_matches(lower(skill), '{p}') AS INT)) AS INT) AS {n}" for n, p in _SKILL_WORDS.items())} FROM one WHERE rn = 1 GROUP BY user_id)"""


def _skills(spark: SparkSession, d: str) -> DataFrame:
    line, o, part = _t(spark, d, "lineitem"), _t(spark, d, "orders"), _t(spark, d, "part")
    rows = line.join(o, line.l_orderkey == o.o_orderkey).join(part, line.l_partkey == part.p_partkey)
    rows = rows.select(F.col("o_custkey").alias("user_id"), F.coalesce(clean.nullify_blank(F.col("p_name")), "p_brand").alias("skill"), (F.col("p_size") > 25).cast("double").alias("predicted"), "p_partkey")
    rows = panel.dealt(rows, "user_id", line.count())
    rows = panel.least_record(rows.where("skill is not null"), ["user_id", "skill"], [F.col("p_partkey")]).withColumns(clean.regex_flags(F.lower("skill"), _SKILL_WORDS))
    return rows.groupBy("user_id").agg(F.count_distinct("skill").alias("distinct_skills"), r(F.avg("predicted")).alias("predicted_share"), *(F.max(n).alias(n) for n in _SKILL_WORDS))


@_query(f"WITH {_SKILLS} SELECT * FROM skills")
def a9_skill_features(spark: SparkSession, d: str) -> DataFrame:
    """Each user's skills, deduplicated by a total order: distinct count, mean predicted, flags by domain."""
    return _skills(spark, d)


@_query(f"""WITH {_EDUCATION}, {_SKILLS} SELECT c_custkey AS user_id, c_mktsegment, coalesce(education_records, 0) AS education_records, coalesce(distinct_skills, 0) AS distinct_skills, coalesce(has_master, 0) AS has_master, coalesce(metal_skill, 0) AS metal_skill,
  best_degree, predicted_share, greatest(best_degree, CAST(2 + c_custkey % 3 AS INT)) AS better_degree FROM customer LEFT JOIN education ON c_custkey = education.user_id LEFT JOIN skills ON c_custkey = skills.user_id""")
def j2_user_features(spark: SparkSession, d: str) -> DataFrame:
    """Education and skill features on users, nulls filled by column, the better of two degree scores."""
    users = _t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    out = panel.attach(panel.attach(users, _education(spark, d), ["user_id"]), _skills(spark, d), ["user_id"])
    out = clean.fill(clean.ensure_columns(out, {"patents": "int"}), {"education_records": 0, "distinct_skills": 0, "has_master": 0, "metal_skill": 0, "absent": 0})
    better = clean.rank_flags(F.col("best_degree"), F.lit(None), F.lit(None), (2 + F.col("user_id") % 3).cast("int"))["best_degree"]
    wanted = ["user_id", "c_mktsegment", "education_records", "distinct_skills", "has_master", "metal_skill", "best_degree", "predicted_share", "not_there"]
    return out.select(*clean.existing(out, wanted), better.alias("better_degree"))


@_query("""SELECT n_regionkey AS parent, min(n_name) AS first_name, min(s_name) AS first_supplier, count(DISTINCT s_suppkey) AS n_firms, count(DISTINCT n_nationkey) AS n_children, round(max(s_acctbal), 2) AS most, CAST(min(nullif(r_name, '')) IS NOT NULL AS INT) AS is_public
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY n_regionkey""")
def a10_company_static(spark: SparkSession, d: str) -> DataFrame:
    """A10, A1: static attributes of parents, distinct children, a flag of what is known."""
    n, s, g = _t(spark, d, "nation"), _t(spark, d, "supplier"), _t(spark, d, "region")
    rows = n.join(s, s.s_nationkey == n.n_nationkey, "left").join(g, g.r_regionkey == n.n_regionkey, "left").withColumn("ticker", F.nullif("r_name", F.lit("")))
    spec = [("first_name", "n_name", "first"), ("first_supplier", "s_name", "first"), ("n_firms", "s_suppkey", "nunique"), ("n_children", "n_nationkey", "nunique"), ("most", "s_acctbal", "max"), ("ticker", "ticker", "first")]
    out = panel.build_panel(rows.withColumns({"parent": F.col("n_regionkey"), "one": F.lit(1)}), ["parent"], "one", [Measure(*m) for m in spec])
    return out.withColumns({"most": r("most", 2), "is_public": clean.flag(F.col("ticker").isNotNull())}).drop("ticker")


@_query(f"""WITH {_WIDE}, f AS (SELECT firm, year, count(DISTINCT user_id) AS n_users, round(ln(sum(salary * w) / sum(w)), 6) AS log_pay FROM flagged GROUP BY firm, year), u AS (SELECT user_id, firm, year, sum(w) AS w FROM flagged GROUP BY user_id, firm, year)
SELECT u.user_id, u.firm, u.year, u.w, n_users AS employer_n_users, log_pay AS employer_log_pay, greatest(n_users - 1, 0) AS coworkers, s_name AS firm_name, CASE WHEN u.year >= 1996 + u.firm % 5 THEN CAST(u.year - (1996 + u.firm % 5) AS BIGINT) END AS firm_age
FROM u LEFT JOIN f ON u.firm = f.firm AND u.year = f.year LEFT JOIN supplier ON s_suppkey = u.firm""")
def j7_employer_context(spark: SparkSession, d: str) -> DataFrame:
    """A user's firms with their firm-year's context under a prefix, coworkers, static attributes and age."""
    static = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("firm"), F.col("s_name").alias("firm_name"), (1996 + F.col("s_suppkey") % 5).alias("founded"))
    pay = F.sum(F.col("salary") * F.col("w"))
    with released(spark):  # firms are summed from their users, so that lines are joined once
        users = stable(_flagged(spark, d).groupBy("user_id", "firm", "year").agg(F.sum("w").alias("w"), pay.alias("pay")))
        firms = users.groupBy("firm", "year").agg(F.count("user_id").alias("n_users"), r(F.log(F.try_divide(F.sum("pay"), F.sum("w"))), 6).alias("log_pay"))
        out = panel.attach(panel.attach(users.drop("pay"), firms, ["firm", "year"], "employer_"), panel.small(static), ["firm"])
        out = out.withColumns({"coworkers": F.greatest(F.col("employer_n_users") - 1, F.lit(0)), "firm_age": panel.age(F.col("year"), F.col("founded"))}).drop("founded")
        return stable(out, keep=True)


_XI = """t AS (SELECT s_nationkey AS parent, p_brand AS task, sum(l_quantity) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
tot AS (SELECT parent, sum(n) AS total FROM t GROUP BY 1), xi AS (SELECT parent, task, n / total AS xi FROM t JOIN tot USING (parent)),
occ AS (SELECT DISTINCT s_nationkey AS parent, p_type AS occ FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
wt AS (SELECT p_type AS occ, p_brand AS task, s / sum(s) OVER (PARTITION BY p_type) AS omega FROM (SELECT p_type, p_brand, sum(p_size) AS s FROM part GROUP BY 1, 2)),
c AS (SELECT tot.parent, occ, omega, coalesce(xi, 0) AS xi, total FROM tot JOIN occ USING (parent) JOIN wt USING (occ) LEFT JOIN xi ON xi.parent = tot.parent AND xi.task = wt.task),
m AS (SELECT *, sum(omega * xi) OVER (PARTITION BY parent, occ) AS mean FROM c)"""


def _weights(part: DataFrame) -> DataFrame:
    sums = part.groupBy(F.col("p_type").alias("occ"), F.col("p_brand").alias("task")).agg(F.sum("p_size").alias("rating"))
    return link.task_weights(sums, "occ", "rating").select("occ", "task", "omega")


@_query(f"WITH {_XI} SELECT parent, occ, round(sum(omega * xi), 8) AS average, round(sum(omega * (xi - mean) * (xi - mean)), 8) AS concentration, round(sum(omega * xi) * ln(1 + max(total)), 6) AS scaled FROM m GROUP BY parent, occ")
def a20_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Weighted average and concentration of task exposure in the cells that there are."""
    part, s, line = _t(spark, d, "part"), _t(spark, d, "supplier"), _t(spark, d, "lineitem")
    rows = line.join(s, line.l_suppkey == s.s_suppkey).join(part, line.l_partkey == part.p_partkey).select(F.col("s_nationkey").alias("parent"), F.col("p_type").alias("occ"), F.col("p_brand").alias("task"), "l_quantity")
    sums = rows.groupBy("parent", "occ", "task").agg(F.sum("l_quantity").alias("n"))
    t = sums.groupBy("parent", "task").agg(F.sum("n").alias("n"))
    totals = t.groupBy("parent").agg(F.sum("n").alias("total"))
    xi = t.join(totals, "parent").select("parent", "task", (F.col("n") / F.col("total")).alias("xi"))
    out = link.exposure(sums.select("parent", "occ").distinct(), xi, totals, ["parent"], _weights(part), "occ", "task")
    return out.select("parent", "occ", r("average", 8).alias("average"), r("concentration", 8).alias("concentration"), r("average_scaled", 6).alias("scaled"))


_CHAIN = f"""{_POSTS}, bridge AS (SELECT category, task, n / sum(n) OVER (PARTITION BY category) AS sim, CAST(n / sum(n) OVER (PARTITION BY category) >= 0.2 AS INT) AS exposed FROM (SELECT category, mapped_role AS task, count(*) AS n FROM posting GROUP BY 1, 2)),
n AS (SELECT parent, year, category, count(*) AS n FROM posting WHERE any_study = 1 GROUP BY ALL), tot AS (SELECT parent, year, sum(n) AS total FROM n GROUP BY 1, 2),
xi AS (SELECT n.parent, n.year, task, sum(n * exposed) / max(total) AS xi, sum(n * sim) / max(total) AS xi_sim FROM n JOIN bridge USING (category) JOIN tot ON tot.parent = n.parent AND tot.year = n.year GROUP BY ALL),
cells AS (SELECT DISTINCT parent, year, occ FROM posting),
wt AS (SELECT p_type AS occ, p_brand AS task, s / sum(s) OVER (PARTITION BY p_type) AS omega FROM (SELECT p_type, p_brand, sum(p_size) AS s FROM part GROUP BY 1, 2)),
j AS (SELECT c.parent, c.year, c.occ, coalesce(omega, 0) AS omega, coalesce(xi, 0) AS xi, coalesce(xi_sim, 0) AS xi_sim, coalesce(total, 0) AS total FROM cells c LEFT JOIN wt USING (occ) LEFT JOIN xi ON xi.parent = c.parent AND xi.year = c.year AND xi.task = wt.task LEFT JOIN tot ON tot.parent = c.parent AND tot.year = c.year),
m AS (SELECT *, sum(omega * xi) OVER (PARTITION BY parent, year, occ) AS mean FROM j)"""


@_query(f"""WITH {_CHAIN} SELECT parent, year, occ, max(total) AS total, round(sum(omega * xi), 8) AS average, round(sum(omega * (xi - mean) * (xi - mean)), 8) AS concentration, round(sum(omega * xi_sim), 8) AS twin,
round(sum(omega * xi) * ln(1 + max(total)), 6) AS average_scaled, round(sum(omega * xi_sim) * ln(1 + max(total)), 6) AS twin_scaled FROM m GROUP BY parent, year, occ""")
def a19_exposure_chain(spark: SparkSession, d: str) -> DataFrame:
    """Category counts to tasks by a many-to-many bridge, tasks to occupations by weights, with the similarity twin."""
    posts = _postings(spark, d)
    n = posts.groupBy("category", F.col("mapped_role").alias("task")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("category"))
    bridge = n.select("category", "task", share.alias("sim")).withColumn("exposed", clean.flag(F.col("sim") >= 0.2))
    counts = posts.where("any_study = 1").groupBy("parent", "year", "category").agg(F.count(F.lit(1)).alias("n"))
    tasks, totals = link.task_exposure(counts, bridge, ["parent", "year"], "category", "task")
    cells = posts.select("parent", "year", "occ").distinct()
    out = link.exposure(cells, tasks, totals, ["parent", "year"], _weights(_t(spark, d, "part")), "occ", "task")
    return out.select(
        "parent", "year", "occ", "total", r("average", 8).alias("average"), r("concentration", 8).alias("concentration"), r("twin_average", 8).alias("twin"),
        r("average_scaled", 6).alias("average_scaled"), r("twin_average_scaled", 6).alias("twin_scaled"),
    )


@_query("""WITH q AS (SELECT p_type AS occ, p_brand AS task, avg(p_retailprice) AS rating FROM part WHERE p_size > 40 GROUP BY 1, 2), t AS (SELECT DISTINCT p_type AS occ, p_brand AS task FROM part), o AS (SELECT p_type AS occ, min(p_name) AS title FROM part WHERE p_type <> 'ECONOMY' GROUP BY 1)
SELECT t.occ, t.task, title, round(rating, 4) AS rating, round(greatest(coalesce(rating, 1), 0) / sum(greatest(coalesce(rating, 1), 0)) OVER (PARTITION BY t.occ), 8) AS omega FROM t LEFT JOIN q USING (occ, task) LEFT JOIN o USING (occ)""")
def j14_rated_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks with ratings and occupation titles as far as known, and the rating's share."""
    part = _t(spark, d, "part").select(F.col("p_type").alias("occ"), F.col("p_brand").alias("task"), "p_name", "p_size", "p_retailprice")
    ratings = part.where("p_size > 40").groupBy("occ", "task").agg(F.avg("p_retailprice").alias("rating"))
    titles = part.where("occ <> 'ECONOMY'").groupBy("occ").agg(F.min("p_name").alias("title"))
    out = link.task_weights(link.rated_tasks(part.select("occ", "task").distinct(), ratings, titles, "task", "occ"), "occ", "rating")
    return out.select("occ", "task", "title", r("rating").alias("rating"), r("omega", 8).alias("omega"))


#: Stop words of these queries; callers give their own list.
STOP_WORDS = tuple("a an and are as at be by for from in is it of on or that the this to was were with".split())
_NOT_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _tokens_sql(table: str, key: str) -> str:
    words = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_NOT_STOP}))"
    return f"SELECT {key} AS k, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM (SELECT {key}, {words} AS w FROM {table})"


_SIMS = f"""a AS (SELECT k, term, count(*) AS tf FROM ({_tokens_sql("documents", "doc_id")}) GROUP BY ALL), b AS (SELECT k, term, count(*) AS tf FROM ({_tokens_sql("benchmark", "item_id")}) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark)) / (1.0 + count(*))) + 1 AS idf FROM (SELECT term FROM a UNION ALL SELECT term FROM b) GROUP BY term),
u AS (SELECT k, term, tf * idf AS w FROM a JOIN idf USING (term)), v AS (SELECT k, term, tf * idf AS w FROM b JOIN idf USING (term)),
nu AS (SELECT k, sqrt(sum(w * w)) AS n FROM u GROUP BY k), nv AS (SELECT k, sqrt(sum(w * w)) AS n FROM v GROUP BY k),
dots AS (SELECT u.k AS doc_id, v.k AS item_id, sum(u.w * v.w) AS dot FROM u JOIN v USING (term) GROUP BY ALL),
sims AS (SELECT doc_id, item_id, dot / nu.n / nv.n AS sim FROM dots JOIN nu ON nu.k = doc_id JOIN nv ON nv.k = item_id)"""


@_query(f"""WITH {_SIMS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 9) DESC, item_id) AS rn FROM sims)
SELECT d.doc_id, item_id, round(coalesce(sim, 0), 6) AS sim, CAST(coalesce(sim, 0) > 0 AS INT) AS matched FROM documents d LEFT JOIN (SELECT * FROM k WHERE rn = 1) k ON k.doc_id = d.doc_id""")
def l4_best_match(spark: SparkSession, d: str) -> DataFrame:
    """L1, L4: TF-IDF cosine of documents to benchmark items, the best item of each document."""
    return link.best_matches(_t(spark, d, "documents"), _t(spark, d, "benchmark"), "doc_id", "item_id", STOP_WORDS).withColumn("sim", r("sim", 6))


@_query(f"""WITH {_SIMS}, cells AS (SELECT coalesce(sim, 0) AS sim FROM (SELECT doc_id, item_id FROM documents, benchmark) LEFT JOIN sims USING (doc_id, item_id))
SELECT doc_id, item_id, round(sim, 6) AS sim FROM sims WHERE sim > 0 AND sim >= greatest((SELECT quantile_cont(sim, 0.95) FROM cells), 0.05)""")
def l3_threshold(spark: SparkSession, d: str) -> DataFrame:
    """L1, L3: pairs of documents and benchmark items from the quantile of the whole similarity matrix on."""
    return link.matches_above(_t(spark, d, "documents"), _t(spark, d, "benchmark"), "doc_id", "item_id", STOP_WORDS).withColumn("sim", r("sim", 6))


def _words_sql(table: str, key: str) -> str:
    return f"SELECT {key} AS k, unnest(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''))) AS token FROM {table}"


@_query(f"""WITH a AS ({_words_sql("documents", "doc_id")}), b AS ({_words_sql("benchmark", "item_id")}), x AS (SELECT k, count(*) AS n FROM a GROUP BY k), y AS (SELECT k, count(*) AS n FROM b GROUP BY k),
j AS (SELECT a.k AS doc_id, b.k AS item_id, count(*) AS common FROM a JOIN b USING (token) GROUP BY ALL) SELECT doc_id, item_id, round(common / (x.n + y.n - common), 6) AS sim FROM j JOIN x ON x.k = doc_id JOIN y ON y.k = item_id""")
def l2_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """L2: token-set Jaccard of all documents and benchmark items with a token in common."""
    return link.jaccard(_t(spark, d, "documents"), _t(spark, d, "benchmark"), "doc_id", "item_id").withColumn("sim", r("sim", 6))


def _sims_sql(p: str, left: tuple[str, str], right: tuple[str, str]) -> str:
    """CTEs ``<p>s (k0, k1, sim)``: TF-IDF cosines of two relations with a key and ``text``, fitted on both."""
    (a, ka), (b, kb) = left, right
    return f"""{p}a AS (SELECT k, term, count(*) AS tf FROM ({_tokens_sql(a, ka)}) GROUP BY ALL), {p}b AS (SELECT k, term, count(*) AS tf FROM ({_tokens_sql(b, kb)}) GROUP BY ALL),
{p}i AS (SELECT term, ln((1 + (SELECT count(*) FROM {a}) + (SELECT count(*) FROM {b})) / (1.0 + count(*))) + 1 AS idf FROM (SELECT term FROM {p}a UNION ALL SELECT term FROM {p}b) GROUP BY term),
{p}u AS (SELECT k, term, tf * idf AS w FROM {p}a JOIN {p}i USING (term)), {p}v AS (SELECT k, term, tf * idf AS w FROM {p}b JOIN {p}i USING (term)),
{p}x AS (SELECT k, sqrt(sum(w * w)) AS n FROM {p}u GROUP BY k), {p}y AS (SELECT k, sqrt(sum(w * w)) AS n FROM {p}v GROUP BY k),
{p}d AS (SELECT u.k AS k0, v.k AS k1, sum(u.w * v.w) AS dot FROM {p}u u JOIN {p}v v USING (term) GROUP BY ALL),
{p}s AS (SELECT k0, k1, dot / x.n / y.n AS sim FROM {p}d JOIN {p}x x ON x.k = k0 JOIN {p}y y ON y.k = k1)"""


_OPENINGS = "(SELECT conv_id, min(text) AS text FROM conversations WHERE turn = 0 GROUP BY conv_id)"
_CROSSWALK = f"""occs AS (SELECT conv_id AS occ, text FROM {_OPENINGS}), codes AS (SELECT source AS code, min(text) AS text FROM documents WHERE text <> '' GROUP BY source), {_sims_sql("c", ("occs", "occ"), ("codes", "code"))},
cw AS (SELECT o.occ, code, coalesce(sim, 0) AS sim, CAST(coalesce(sim, 0) > 0 AS INT) AS matched FROM occs o LEFT JOIN (SELECT k0 AS occ, k1 AS code, sim, row_number() OVER (PARTITION BY k0 ORDER BY round(sim, 9) DESC, k1) AS rn FROM cs) k ON k.occ = o.occ AND rn = 1)"""


def _crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """Occupations, here openings of conversations, to codes, here sources by a text of theirs: the best match."""
    occs = _t(spark, d, "conversations").where("turn = 0").groupBy(F.col("conv_id").alias("occ")).agg(F.min("text").alias("text"))
    codes = _t(spark, d, "documents").where("text <> ''").groupBy(F.col("source").alias("code")).agg(F.min("text").alias("text"))
    return link.best_matches(occs, codes, "occ", "code", STOP_WORDS)


@_query(f"""WITH {_CROSSWALK}, {_sims_sql("t", ("documents", "doc_id"), ("benchmark", "item_id"))},
tau AS (SELECT greatest(quantile_cont(coalesce(sim, 0), 0.95), 0.05) AS tau FROM (SELECT doc_id AS k0, item_id AS k1 FROM documents, benchmark) LEFT JOIN ts USING (k0, k1)),
bridge AS (SELECT k0 AS task, k1 AS category, sim FROM ts, tau WHERE sim >= tau),
wt AS (SELECT source AS code, doc_id AS task, n_chars / sum(n_chars) OVER (PARTITION BY source) AS omega FROM documents),
rows AS (SELECT s_nationkey AS parent, CAST(year(l_shipdate) AS INT) AS year, l_partkey % 200 AS category, l_orderkey % 300 AS occ FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
n AS (SELECT parent, year, category, count(*) AS n FROM rows SEMI JOIN benchmark ON item_id = category GROUP BY ALL), tot AS (SELECT parent, year, sum(n) AS total FROM n GROUP BY ALL),
xi AS (SELECT n.parent, n.year, task, sum(n) / max(total) AS xi, sum(n * sim) / max(total) AS xi_sim FROM n JOIN bridge USING (category) JOIN tot ON tot.parent = n.parent AND tot.year = n.year GROUP BY ALL),
cells AS (SELECT DISTINCT parent, year, occ FROM rows), coded AS (SELECT cells.*, code, sim AS match_sim FROM cells LEFT JOIN cw USING (occ)),
j AS (SELECT p.parent, p.year, p.code, omega, coalesce(xi, 0) AS xi, coalesce(xi_sim, 0) AS xi_sim FROM (SELECT DISTINCT parent, year, code FROM coded WHERE code IS NOT NULL) p JOIN wt USING (code) LEFT JOIN xi ON xi.parent = p.parent AND xi.year = p.year AND xi.task = wt.task),
m AS (SELECT *, sum(omega * xi) OVER (PARTITION BY parent, year, code) AS mean FROM j), e AS (SELECT parent, year, code, sum(omega * xi) AS average, sum(omega * (xi - mean) * (xi - mean)) AS concentration, sum(omega * xi_sim) AS twin FROM m GROUP BY ALL)
SELECT c.parent, c.year, c.occ, c.code, round(coalesce(match_sim, 0), 6) AS match_sim, CAST(coalesce(total, 0) AS BIGINT) AS total, round(coalesce(average, 0), 8) AS average, round(coalesce(concentration, 0), 8) AS concentration, round(coalesce(twin, 0), 8) AS twin,
  round(coalesce(average, 0) * ln(1 + coalesce(total, 0)), 6) AS average_scaled FROM coded c LEFT JOIN e ON e.parent = c.parent AND e.year = c.year AND e.code = c.code LEFT JOIN tot ON tot.parent = c.parent AND tot.year = c.year""")
def j12_text_chain(spark: SparkSession, d: str) -> DataFrame:
    """Categories to tasks by similar texts, occupations to codes by the best match, both into the exposure chain."""
    docs, bench, line, s = (_t(spark, d, t) for t in ("documents", "benchmark", "lineitem", "supplier"))
    bridge = link.matches_above(docs, bench, "doc_id", "item_id", STOP_WORDS).select(F.col("doc_id").alias("task"), F.col("item_id").alias("category"), "sim")
    weights = link.task_weights(docs.select(F.col("source").alias("code"), F.col("doc_id").alias("task"), "n_chars"), "code", "n_chars").select("code", "task", "omega")
    rows = line.join(s, line.l_suppkey == s.s_suppkey).select(F.col("s_nationkey").alias("parent"), F.year("l_shipdate").alias("year"), (F.col("l_partkey") % 200).alias("category"), (F.col("l_orderkey") % 300).alias("occ"))
    counts = rows.join(bench, rows.category == bench.item_id, "left_semi").groupBy("parent", "year", "category").agg(F.count(F.lit(1)).alias("n"))
    out = link.text_exposure(rows.select("parent", "year", "occ").distinct(), counts, bridge, _crosswalk(spark, d), weights, ["parent", "year"], "category", "task", "occ", "code")
    return out.select(
        "parent", "year", "occ", "code", r("match_sim", 6).alias("match_sim"), F.col("total").cast("long").alias("total"), r("average", 8).alias("average"), r("concentration", 8).alias("concentration"),
        r("twin_average", 8).alias("twin"), r("average_scaled", 6).alias("average_scaled"),
    )


@_query(f"WITH {_CROSSWALK} SELECT count(*) AS n, count(CASE WHEN matched = 1 THEN 1 END) AS n_matched, round(avg(CASE WHEN matched = 1 THEN sim END), 6) AS mean_sim, round(min(CASE WHEN matched = 1 THEN sim END), 6) AS low_sim, round(max(CASE WHEN matched = 1 THEN sim END), 6) AS high_sim FROM cw")
def r14_match_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How well the crosswalk matches: rows, matched rows, mean, least and most similarity."""
    out = link.match_diagnostics(_crosswalk(spark, d))
    return out.withColumns({c: r(c, 6) for c in ("mean_sim", "low_sim", "high_sim")})


@_query("""WITH c AS (SELECT s_suppkey AS child, 1000000 + s_nationkey AS direct, n_regionkey AS parent, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
u AS (SELECT child AS entity, parent, s_name AS name, r_name AS parent_name FROM c UNION SELECT direct, parent, n_name, r_name FROM c), k AS (SELECT entity, min(parent) AS parent, min(name) AS name, min(parent_name) AS parent_name FROM u GROUP BY entity),
p AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey WHEN l_linenumber % 3 = 0 THEN 1000000 + l_suppkey % 30 ELSE NULL END AS entity, l_quantity FROM lineitem)
SELECT p.entity, parent, name, parent_name, count(*) AS n, sum(l_quantity) AS q FROM p LEFT JOIN k ON k.entity = p.entity GROUP BY ALL""")
def j1_entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Positions to parents by a lookup of child ids united with direct ids; unknown ids stay without a parent."""
    s, n, g, line = (_t(spark, d, t) for t in ("supplier", "nation", "region", "lineitem"))
    companies = s.join(n, s.s_nationkey == n.n_nationkey).join(g, n.n_regionkey == g.r_regionkey).withColumn("direct", F.lit(1000000).cast("long") + F.col("s_nationkey"))
    lookup = panel.entity_lookup(companies, "s_suppkey", "direct", {"parent": "n_regionkey", "name": "s_name", "parent_name": "r_name"}, {"parent": "n_regionkey", "name": "n_name", "parent_name": "r_name"})
    entity = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).when(F.col("l_linenumber") % 3 == 0, 1000000 + F.col("l_suppkey") % 30)
    rows = line.select(entity.alias("entity"), "l_quantity").groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return panel.attach(rows, lookup, ["entity"]).select("entity", "parent", "name", "parent_name", "n", "q")


@_query(f"""WITH a AS ({_words_sql("documents", "doc_id")}), b AS ({_words_sql("benchmark", "item_id")}), x AS (SELECT k, count(*) AS n FROM a GROUP BY k), y AS (SELECT k, count(*) AS n FROM b GROUP BY k),
j AS (SELECT a.k AS doc_id, b.k AS item_id, count(*) AS common FROM a JOIN b USING (token) GROUP BY ALL), s AS (SELECT doc_id, item_id, common / (x.n + y.n - common) AS sim FROM j JOIN x ON x.k = doc_id JOIN y ON y.k = item_id) SELECT doc_id, item_id, round(sim, 6) AS sim FROM s WHERE sim >= 0.1""")
def l2_jaccard_above(spark: SparkSession, d: str) -> DataFrame:
    """L2: pairs of documents and benchmark items with a token-set Jaccard of at least 0.1, by rare tokens first."""
    return link.jaccard_above(_t(spark, d, "documents"), _t(spark, d, "benchmark"), "doc_id", "item_id", 0.1).withColumn("sim", r("sim", 6))
