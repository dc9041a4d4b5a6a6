"""Two-way effects against dummy regressions, exact quantiles by bands, entity samples, sources, and odd inputs of the helpers."""

import numpy as np
import pytest
from panelspark import clean, io, link, panel, regress
from pyspark.sql import functions as F


def panel_rows(n=400, seed=3):
    rng = np.random.default_rng(seed)
    f, t = rng.integers(0, 25, n), rng.integers(0, 8, n)
    x = rng.normal(size=n) + 0.3 * f
    y = 1.5 * x + f - 0.5 * t + rng.normal(size=n)
    return [(int(a), int(b), int(a) % 9, float(c), float(d)) for a, b, c, d in zip(f, t, x, y, strict=True)]


def dummies(*labels):
    return np.hstack([(np.array(lab)[:, None] == np.unique(lab)).astype(float) for lab in labels])


def test_two_way_effects_against_dummies(spark):
    rows = panel_rows()
    df = spark.createDataFrame(rows, "f int, t int, g int, x double, y double")
    within = regress.residualise(df, ["y", "x"], ["f"], ["t"], max_rounds=400)
    (got,) = regress.cluster_ols(within, "y", ["x"], "g", constant=False)
    f, t, g, x, y = map(np.array, zip(*rows, strict=True))
    d = dummies(f, t)
    out = lambda v: v - d @ np.linalg.lstsq(d, v, rcond=None)[0]
    xr, yr = out(x), out(y)
    beta = (xr @ yr) / (xr @ xr)
    u = yr - beta * xr
    scores = np.array([(xr * u)[g == k].sum() for k in np.unique(g)])
    n, c = len(rows), len(np.unique(g))
    se = np.sqrt(c / (c - 1) * (n - 1) / (n - 1) * (scores**2).sum()) / (xr @ xr)
    assert got["coef"] == pytest.approx(beta, abs=1e-6) and got["se"] == pytest.approx(se, rel=1e-5)
    assert (got["n"], got["clusters"]) == (n, c)


def test_one_way_effects_count_dummies(spark):
    rows = panel_rows()
    df = spark.createDataFrame(rows, "f int, t int, g int, x double, y double").withColumn("same", F.lit(1.0))
    found = regress.fe_ols(df, "y", ["x", "same"], "g", ["f"])
    assert [r["term"] for r in found] == ["x", "same"] and found[1]["coef"] is None
    f, _, g, x, y = map(np.array, zip(*rows, strict=True))
    z = np.column_stack([x, dummies(f)])
    inverse = np.linalg.inv(z.T @ z)
    beta = inverse @ z.T @ y
    u = y - z @ beta
    meat = sum(np.outer(z[g == k].T @ u[g == k], z[g == k].T @ u[g == k]) for k in np.unique(g))
    n, c, k = len(y), len(np.unique(g)), 2 + len(np.unique(f))  # with the constant one, which has no variance
    se = np.sqrt((c / (c - 1) * (n - 1) / (n - k) * inverse @ meat @ inverse)[0, 0])
    assert found[0]["coef"] == pytest.approx(beta[0]) and found[0]["se"] == pytest.approx(se)
    assert found[0]["r2"] == pytest.approx(1 - (u @ u) / ((y - y.mean()) ** 2).sum())


def test_robustness_grid(spark):
    rows = [(*r, 10 * (i % 7), i % 2, i % 3) for i, r in enumerate(panel_rows(240))]
    df = spark.createDataFrame(rows, "f int, t int, g int, x double, y double, n_workers int, top_decile_group_a int, top_decile_group_b int")
    got = regress.robustness_grid(df, ["y"], "n_workers", ["x"], [], ["f"], ["t"], "g", ["baseline", "min_workers_50"])
    assert {(r["sample"], r["winsorised"]) for r in got} == {(s, w) for s in ("baseline", "min_workers_50") for w in "01"}
    whole = {r["sample"]: r["n"] for r in got}
    assert whole == {"baseline": 240, "min_workers_50": sum(r[5] >= 50 for r in rows)}
    with pytest.raises(ValueError, match="unknown sample"):
        clean.sample_filter(df, "other")


def test_not_a_number_is_left_out(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + (i % 3), i % 5) for i in range(40)] + [(float("nan"), 1.0, 1), (1.0, float("inf"), 2), (None, 3.0, 3)], "x double, y double, g int")
    const, slope = regress.cluster_ols(df, "y", ["x"], "g")
    assert slope["n"] == 40 and slope["coef"] == pytest.approx(2.0, abs=0.05) and const["coef"] is not None
    assert regress.cluster_ols(df.limit(0), "y", ["x"], "g")[1]["coef"] is None


@pytest.mark.parametrize("most", [50, 10_000])
def test_exact_quantiles(spark, most):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=3000), np.repeat(0.25, 800), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    at = [0.0, 0.01, 0.333, 0.5, 0.55, 0.99, 1.0]
    assert regress.quantiles(df, "x", at, most) == pytest.approx(list(np.quantile(values, at)), abs=1e-9)
    assert regress.quantiles(df.limit(0), "x", [0.5], most) == [None]


def test_null_effects_are_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 5.0)], "f int, x double")
    for small in (True, False, None):
        assert sorted(r.x for r in regress.demean(df, ["x"], ["f"], small).collect()) == [-1.0, 0.0, 1.0]


def test_entity_sample_keeps_entities_whole(spark):
    df = spark.createDataFrame([(i % 200, i) for i in range(2000)], "k long, v long")
    got = io.entity_sample(df, "k", 300)
    counts = {r.k: r["count"] for r in got.groupBy("k").count().collect()}
    assert set(counts.values()) == {10} and 30 < len(counts) < 90


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k long, v string")
    io.write_parquet(df, str(tmp_path / "t"), 1)
    one = io.file_inventory(spark, str(tmp_path / "t")).first()
    assert (one.n_files, one.has_success, one.has_temporary) == (1, True, False) and one.total_bytes > 0
    (tmp_path / "t" / "_temporary").mkdir()
    (tmp_path / "t" / "_SUCCESS").unlink()
    one = io.file_inventory(spark, str(tmp_path / "t")).first()
    assert (one.has_success, one.has_temporary) == (False, True)
    assert io.read_parquet(spark, str(tmp_path / "t"), legacy_calendar=True).count() == 2
    io.write_csv(df, str(tmp_path / "c"))
    (part,) = (tmp_path / "c").glob("part-*.csv")
    assert part.read_text() == 'k,v\n1,"a,b"\n2,""\n' or part.read_text() == 'k,v\n1,"a,b"\n2,\n'
    assert [tuple(r) for r in io.parameter_table(spark, [("a", 1)], "k string, v int").collect()] == [("a", 1)]


def test_tfidf_needs_a_list_of_stop_words(spark):
    left = spark.createDataFrame([(1, "the house of the été"), (2, None)], "l long, text string")
    right = spark.createDataFrame([("a", "été house"), ("b", "the of")], "r string, text string")
    got = link.tfidf_similarity(left, right, "l", "r", ["the", "of"]).collect()
    assert [(r.l, r.r) for r in got] == [(1, "a")] and 0 < got[0].sim < 1
    best = {r.l: (r.r, r.matched) for r in link.best_match(left, link.tfidf_similarity(left, right, "l", "r", []), "l", "r").collect()}
    assert best == {1: ("b", 1), 2: (None, 0)} or best == {1: ("a", 1), 2: (None, 0)}


def test_attach_and_age(spark):
    left = spark.createDataFrame([(1, 2000), (2, 2000)], "k int, year int")
    right = spark.createDataFrame([(1, 5), (1, 7)], "k int, v int")
    got = {r.k: r.c_v for r in panel.attach(left, right, ["k"], "c_", [F.desc("v")]).collect()}
    assert got == {1: 7, 2: None}
    assert [r[0] for r in left.select(panel.age(F.col("year"), F.lit(2001) - F.col("k"))).collect()] == [0, 1]
    with pytest.raises(ValueError, match="none of"):
        clean.first_column(left, ["x"])


def exchanges(df):
    """Shuffles of a plan before it runs, reused ones too."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize(("name", "most"), [("a4_firm_year_wide", 8), ("a5_posting_firm_year", 10), ("a6_worker_year", 8), ("a17_posting_parent_occ_year", 1), ("j7_employer_context", 1)])
def test_lines_are_joined_once(spark, name, most):
    """one pass over the joined lines; before, each distinct table and context joined them again."""
    from panelspark import queries

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(queries.queries()[name](spark, "/root/testdata/sf0.001")) <= most
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_skills_are_dealt_by_user(spark):
    """a user's skills are met and counted in one task, without a further shuffle by user and skill."""
    from panelspark import wide_queries

    plan = wide_queries._skills(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "skill#" not in "".join(x for x in plan.split("\n") if "Exchange" in x)
