"""Hand-made cases for nulls, ties, gaps and text traps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark import clean, io, link, panel, regress


def test_spells(spark):
    rows = [("a", "1999-05-01", "2001-02-01", 2003), ("b", "2002-01-01", None, 2003), ("c", None, "2000-06-01", 2003), ("d", None, None, 2001), ("e", "2005-01-01", "2001-01-01", 2003)]
    df = spark.createDataFrame(rows, "id string, s string, e string, snap int").withColumns({"s": F.to_date("s"), "e": F.to_date("e")})
    years = panel.expand_to_years(panel.impute_years(panel.repair_spell(df, "s", "e"), "s", "e", "snap", 2003), "s", "e")
    got = {}
    for r in years.orderBy("id", "year").collect():
        got.setdefault(r.id, []).append((r.year, r.is_hire, r.is_exit, r.is_censored))
    assert [y[0] for y in got["a"]] == [1999, 2000, 2001] and got["a"][0][1] == 1 and got["a"][2][2] == 1
    assert got["b"] == [(2002, 1, 0, 0), (2003, 0, 0, 1)]
    assert got["c"] == [(2000, 0, 1, 0)] and got["d"] == [(2001, 0, 0, 1)] and [y[0] for y in got["e"]] == [2003]


def test_weighted_means(spark):
    df = spark.createDataFrame([(10.0, 1.0), (None, 2.0), (20.0, 3.0)], "x double, w double")
    r = panel.build_panel(df, [], "w", [panel.Measure("o", "x"), panel.Measure("a", "x", denom="all")]).first()
    assert r.o == 17.5 and round(r.a, 6) == 11.666667


def test_leads_over_a_gap(spark):
    df = spark.createDataFrame([(y, float(i + 1)) for i, y in enumerate([2000, 2001, 2003, 2004, 2005, 2006])], "year int, x double").withColumn("k", F.lit(1))
    r = df.select("year", panel.shifted("x", ["k"], "year", 5).alias("row"), panel.shifted("x", ["k"], "year", 5, True).alias("cal")).where("year = 2000").first()
    assert (r["row"], r.cal) == (6.0, 5.0)


def test_text(spark):
    df = spark.createDataFrame([(" None ",), ("NaN",), ("",), ("a  b",), (None,), ("--A&B Co.--",)], "t string")
    got = [tuple(r) for r in df.select(clean.nullify_blank(F.col("t")), clean.slug(F.col("t"))).collect()]
    assert [g[0] for g in got[:4]] == [None, None, None, "a b"] and got[4][1] == "missing" and got[5][1] == "a_b_co"
    one = spark.createDataFrame([("People Analytics Manager",)], "t string")
    assert one.select(clean.normalize_text(F.col("t"))).first()[0] == "people analytics manager"
    assert one.select(clean.normalize_text(F.col("t"), strip_upper=True)).first()[0] == "eople nalytics anager"
    codes = spark.createDataFrame([("541-512",), ("abc",), (None,)], "c string").select(clean.industry_prefix(F.col("c")))
    assert [r[0] for r in codes.collect()] == ["541", None, None]


def test_concentration(spark):
    df = spark.createDataFrame([(1, 1, 0, 0), (0, 0, 0, 0)], "a int, b int, c int, d int")
    assert [r[0] for r in df.select(panel.concentration([F.col(c) for c in "abcd"])).collect()] == [0.5, None]


def test_tfidf(spark):
    left = spark.createDataFrame([(1, "monitor employee productivity")], "l long, text string")
    right = spark.createDataFrame([(1, "monitor productivity"), (2, "paint walls")], "r long, text string")
    got = link.tfidf_similarity(left, right, "l", "r", ["the"]).collect()
    assert [(r.r, round(r.sim, 8)) for r in got] == [(1, 0.38634343)]


def test_exposure(spark):
    xi = spark.createDataFrame([("p", 1, 0.75), ("p", 2, 1.0)], "e string, task int, xi double")
    totals = spark.createDataFrame([("p", 4)], "e string, total long")
    weights = spark.createDataFrame([("o", 1, 0.5), ("o", 2, 0.3), ("o", 3, 0.2)], "occ string, task int, omega double")
    cells = spark.createDataFrame([("p", "o")], "e string, occ string")
    r = link.exposure(cells, xi, totals, ["e"], weights, "occ", "task").first()
    assert (round(r.average, 6), round(r.concentration, 6)) == (0.675, 0.125625)
    assert (round(r.average_scaled, 8), round(r.concentration_scaled, 8)) == (1.08637059, 0.20218564)


def test_cluster_ols(spark):
    df = spark.createDataFrame(list(zip(map(float, range(1, 7)), [1.0, 3.0, 2.0, 5.0, 4.0, 6.0], "aabbcc", strict=True)), "x double, y double, g string")
    const, slope = regress.cluster_ols(df, "y", ["x"], "g")
    assert (round(const["coef"], 8), round(slope["coef"], 8)) == (0.4, 0.88571429)
    assert (round(const["se"], 8), round(slope["se"], 8)) == (0.39550192, 0.10130757)
    assert const["p"] == pytest.approx(0.31183784, abs=1e-6) and round(const["r2"], 8) == 0.78448980


def test_two_way(spark):
    rows = list(zip([0, 0, 1, 1, 2, 2, 2], [0, 1, 0, 1, 0, 1, 1], [1.0, 4.0, 2.0, 8.0, 5.0, 7.0, 3.0], range(7), strict=True))
    df = spark.createDataFrame(rows, "f int, g int, v double, i int")
    got = [r.v for r in regress.residualise(df, ["v"], ["f"], ["g"], 30).orderBy("i").collect()]
    assert np.allclose(got, [-0.15, 0.15, -1.65, 1.65, 1.8, 1.1, -2.9], atol=1e-6)


def test_two_way_converges_or_raises(spark):
    rows = [(f, g, float((7 * f + 3 * g * g) % 11)) for f in range(12) for g in (f // 2, f // 2 + 1)]  # few years a firm
    df = spark.createDataFrame(rows, "f int, g int, v double")
    with pytest.raises(RuntimeError, match="over 1.00e-08 after 6"):
        regress.residualise(df, ["v"], ["f"], ["g"], max_rounds=6)
    got = {(r.f, r.g): r.v for r in regress.residualise(df, ["v"], ["f"], ["g"], max_rounds=1000).collect()}
    x = np.array([[float(f == i) for i in range(12)] + [float(g == i) for i in range(7)] for f, g, _ in rows])
    y = np.array([v for *_, v in rows])
    expected = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.abs(np.array([got[f, g] for f, g, _ in rows]) - expected).max() < 1e-3


def test_winsorise(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "x double")
    got = sorted(r.x for r in regress.winsorise(df, "x").collect())
    assert got[0] == pytest.approx(1.04) and got[-1] == pytest.approx(96.16)


def test_io(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    io.write_parquet(df, str(tmp_path / "t"), 2)
    assert io.read_parquet(spark, str(tmp_path / "t"), recursive=True).count() == 2
    assert io.file_inventory(spark, str(tmp_path / "t")).first().n_files == 2
    (tmp_path / "x.txt").write_text("﻿Task ID \tTask\n1\ta\n", encoding="utf-8")
    assert io.read_tsv(spark, str(tmp_path / "x.txt")).columns == ["Task ID", "Task"]
    io.write_csv(df, str(tmp_path / "c"))
    io.write_json_summary(df.limit(1), str(tmp_path / "j"))
    assert math.isclose(spark.read.json(str(tmp_path / "j")).first().k, 1)
