"""Pruned similarity joins, grouped exact quantiles, distincts, stocks, samples, sketches, fast two-way effects, verified writes."""

import random
import re

import duckdb
import numpy as np
import pytest
from panelspark import audit, io, link, panel, queries, regress, sketches
from pyspark.sql import functions as F


def texts(rng, n, words, prefix):
    return [(f"{prefix}{i}" if prefix else i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.choice([0, 1, 4, 15, 60])))) for i in range(n)]


def cosines(left, right):
    """All similarities by dense vectors."""
    import re

    def terms(t):
        w = re.findall(r"\w\w+", (t or "").lower())
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    rows = [terms(t) for _, t in left + right]
    names = {t: i for i, t in enumerate(sorted({t for r in rows for t in r}))}
    x = np.zeros((len(rows), max(1, len(names))))
    for i, r in enumerate(rows):
        for t in r:
            x[i, names[t]] += 1
    x *= np.log((1 + len(rows)) / (1 + (x > 0).sum(axis=0))) + 1
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    return x[: len(left)] @ x[len(left) :].T


@pytest.fixture(scope="module")
def lists(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("mon", "tas", "wor", "ski", "job") for b in ("itor", "ks", "ers", "lls", "ber", "ion")]
    left, right = texts(rng, 90, words, ""), texts(rng, 40, words, "r")
    left += [(200, None), (201, left[5][1]), (202, right[7][1])]
    return left, right, spark.createDataFrame(left, "k long, text string").repartition(3), spark.createDataFrame(right, "j string, text string")


@pytest.mark.parametrize(("q", "floor"), [(0.95, 0.05), (0.5, 0.3), (0.999, 0.01), (0.0, 0.6)])
def test_matches_above(lists, q, floor):
    left, right, a, b = lists
    s = cosines(left, right)
    tau = max(np.quantile(s, q), floor)
    got = {(r.k, r.j): r.sim for r in link.matches_above(a, b, "k", "j", [], q, floor).collect()}
    clear = {(left[i][0], right[j][0]): s[i, j] for i, j in zip(*np.nonzero(s >= tau + 1e-9))}
    assert set(clear) <= set(got) and all(s[[x for x, _ in left].index(k), [y for y, _ in right].index(j)] >= tau - 1e-9 for k, j in got)
    assert all(got[p] == pytest.approx(v, abs=1e-9) for p, v in clear.items()) and len(clear) > 3


def test_best_matches(lists):
    left, right, a, b = lists
    s = np.round(cosines(left, right), 9)
    got = {r.k: r for r in link.best_matches(a, b, "k", "j", []).collect()}
    assert len(got) == len(left)
    for i, (k, _) in enumerate(left):
        best = min((j for (j, _), v in zip(right, s[i], strict=True) if v == s[i].max()), default=None) if s[i].max() > 0 else None
        assert (got[k].j, got[k].matched) == (best, int(best is not None)) and got[k].sim == pytest.approx(s[i].max(), abs=1e-8)


@pytest.mark.parametrize("least", [0.05, 0.3, 0.5, 1.0])
def test_jaccard_above(lists, least):
    left, right, a, b = lists
    sets = [[(k, set((t or "").split())) for k, t in rows] for rows in (left, right)]
    want = {(k, j): len(x & y) / len(x | y) for k, x in sets[0] for j, y in sets[1] if x & y and len(x & y) >= least * len(x | y)}
    got = {(r.k, r.j): r.sim for r in link.jaccard_above(a, b, "k", "j", least).collect()}
    assert got == pytest.approx(want) and len(want) > 0


def test_no_terms_in_common(spark):
    a, b = spark.createDataFrame([(1, "one"), (2, "")], "k int, text string"), spark.createDataFrame([("x", "two")], "j string, text string")
    assert link.matches_above(a, b, "k", "j", []).count() == 0
    assert sorted(map(tuple, link.best_matches(a, b, "k", "j", []).collect())) == [(1, None, 0.0, 0), (2, None, 0.0, 0)]
    assert link.best_matches(a.limit(0), b, "k", "j", []).count() == 0


def test_exact_quantiles_of_groups(spark):
    rng = np.random.default_rng(2)
    groups = {"hot": rng.normal(size=4000), "ties": np.repeat([1.0, 2.0, 2.0, 5.0], 50), "one": np.array([7.0]), None: rng.normal(size=31), "odd": np.array([-1e9, 0.0, 1e9])}
    rows = [(g, float(v)) for g, own in groups.items() for v in own] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    at = {f"q{i}": q for i, q in enumerate((0.0, 0.01, 0.333, 0.5, 0.75, 0.99, 1.0))}
    got = {r.g: r for r in audit.exact_quantiles(df, ["g"], "v", at).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        assert [got[g][c] for c in at] == pytest.approx(list(np.quantile(own, list(at.values()))), rel=1e-12, abs=1e-9)
    (whole,) = audit.exact_quantiles(df, [], "v", {"m": 0.5}).collect()
    assert whole.m == pytest.approx(np.median(np.concatenate(list(groups.values()))))
    assert audit.exact_quantiles(df.limit(0), ["g"], "v", at).count() == 0


def test_distincts_in_a_panel(spark):
    rows = [("a", 1, "x", 0.0, 2.0), ("a", 1, "y", -0.0, 3.0), ("a", 1, None, None, None), (None, 2, "z", 1.5, 1.0), ("b", 1, None, None, 4.0)]
    df = spark.createDataFrame(rows, "k string, u long, s string, v double, w double")
    m = panel.Measure
    out = panel.build_panel(df, ["k"], "w", [m("n_s", "s", "nunique"), m("sum", "v", "sum"), m("n_v", "v", "nunique"), m("low", "s", "first"), m("n_u", "u", "nunique"), m("high", "s", "max")])
    assert out.columns == ["k", "n_s", "sum", "n_v", "low", "n_u", "high"]
    assert {r.k: tuple(r)[1:] for r in out.collect()} == {"a": (2, 0.0, 1, "x", 1, "y"), None: (1, 1.5, 1, "z", 1, "z"), "b": (0, None, 0, None, 1, None)}
    assert "Expand" not in out._jdf.queryExecution().toString()


def test_stocks_are_those_of_expanded_spells(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), s, s + rng.choice([0, 0, 1, 3, 40]), rng.choice([0.1, 0.7, 1.0])) for s in (rng.randint(1960, 2020) for _ in range(60))] + [("c", 1999, None, 1.0), ("d", 2001, 2000, 1.0)]
    df = spark.createDataFrame(rows, "k string, start_year int, end_year int, w double")
    want = {}
    for k, s, e, w in rows:
        for y in range(s, (e if e is not None else s - 1) + 1):
            own = want.setdefault((k, y), [0, 0.0, 0.0, 0.0])
            for i, v in enumerate((1, w, w * (y == s), w * (y == e))):
                own[i] += v
    got = {(r.k, r.year): [r.n_spells, r.stock, r.hires, r.exits] for r in panel.stocks(df, ["k"], "w").collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)


def test_least_record_is_the_windows_first(spark):
    rng = random.Random(3)
    day = lambda: rng.choice([None, "2001-02-03", "1999-12-31", "2010-01-01"])
    rows = [(rng.choice("abc"), rng.choice([None, 1.0, 2.0, -3.0]), day(), i) for i in range(200)] + [(None, None, None, 900)]
    df = spark.createDataFrame(rows, "k string, w double, d string, i int").withColumn("d", F.to_date("d")).repartition(5)
    want = panel.primary_record(df, ["k"], [F.desc_nulls_last("w"), F.desc_nulls_last("d"), F.col("i")])
    got = panel.least_record(df, ["k"], [panel.down(F.col("w")), panel.down(F.col("d"), date=True), F.col("i")], {"n": F.count(F.lit(1))})
    assert {tuple(r)[:4] for r in got.collect()} == {tuple(r) for r in want.collect()} and sum(r.n for r in got.collect()) == 201
    assert "Window" not in got._jdf.queryExecution().toString()


def test_exact_samples(spark):
    df = spark.createDataFrame([(i, i % 7, i % 90) for i in range(900)], "k long, g long, e long")
    picks = [{r.k for r in io.exact_sample(df.repartition(n), ["k"], 25).collect()} for n in (1, 5)]
    assert picks[0] == picks[1] and len(picks[0]) == 25
    by = io.exact_sample(df.repartition(4), ["k"], 11, ["g"]).groupBy("g").count().collect()
    assert {r["count"] for r in by} == {11} and len(by) == 7
    assert io.exact_sample(df, ["k"], 5000).count() == 900
    whole = io.exact_entity_sample(df, "e", 13).groupBy("e").count().collect()
    assert len(whole) == 13 and {r["count"] for r in whole} == {10}


def test_sketches_keep_their_errors(spark):
    rng = np.random.default_rng(8)
    values = rng.lognormal(size=60_000)
    df = spark.createDataFrame([(i % 40, i % 4, i // 2, float(v)) for i, v in enumerate(values)], "fine int, coarse int, id long, v double")
    fine = sketches.sketch_panel(df, ["fine", "coarse"], {"ids": "id"}, {"v": "v"})
    for keys in (["coarse"], []):
        for r in sketches.estimates(sketches.merge(fine, keys, ["ids"], ["v"]), ["ids"], {"v": (0.1, 0.5, 0.99)}).collect():
            own = values[np.arange(len(values)) % 4 == r.coarse] if keys else values
            exact = len({i // 2 for i in range(len(values)) if not keys or i % 4 == r.coarse})
            assert exact > 10_000 and r.n == len(own) and abs(r.ids / exact - 1) < sketches.DISTINCT_ERROR
            assert all(abs((own <= r[f"v_p{round(100 * q)}"]).mean() - q) < sketches.RANK_ERROR for q in (0.1, 0.5, 0.99))


def chain(seed=2):
    """A skewed panel whose groups hang together by few cells, in two separate sets, with nulls and rows that stand alone."""
    rng = np.random.default_rng(seed)
    rows = [(f, g) for f in range(60) for g in (f // 3, f // 3 + 1) for _ in range(1 + 40 * (f == 0))] + [(100 + f, 50 + f % 3) for f in range(12) for _ in range(2)]
    return [(f if f < 110 else None, g, float(rng.normal() + f * (f < 110)), float(rng.normal() + g)) for f, g in rows]


def test_fast_two_way_effects(spark):
    rows = chain()
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "f int, g int, y double, x double, i int")
    d = np.array([[a == f for f in {r[0] for r in rows}] + [b == g for g in {r[1] for r in rows}] for a, b, *_ in rows], float)
    with pytest.raises(RuntimeError, match="left"):
        regress.residualise_fast(df, ["y", "x"], ["f"], ["g"], max_rounds=2)
    got = regress.residualise_fast(df, ["y", "x"], ["f"], ["g"]).orderBy("i").collect()
    for k, c in ((2, "y"), (3, "x")):
        v = np.array([r[k] for r in rows])
        assert np.abs(np.array([r[c] for r in got]) - (v - d @ np.linalg.lstsq(d, v, rcond=None)[0])).max() < 1e-5
    assert regress.effect_degrees(df, ["f"], ["g"]) == np.linalg.matrix_rank(d)
    sets = {r.g: r.component for r in regress.connected_sets(df, ["f"], ["g"]).collect()}
    assert len(set(sets.values())) == len({r[0] for r in rows} | {(r[1],) for r in rows}) - np.linalg.matrix_rank(d) and sets[0] == sets[20] != sets[50]


def test_rows_that_stand_alone(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 1), (3, 1), (4, 9), (4, 9), (5, 2), (5, 7)], "f int, g int")
    got = sorted(map(tuple, regress.without_singletons(df, ["f"], ["g"]).collect()))
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2), (4, 9), (4, 9)]  # 3 stands alone; 7 does, and then 5


def test_result_slices(spark):
    rows = [(s, y, i, w, t) for s in ("baseline", "big") for y in ("u", "v") for i in ("composite", "a") for w in "01" for t in (f"n_x_{i}", "control")]
    df = spark.createDataFrame(rows, "sample string, outcome string, index_name string, winsorised string, term string")
    got = {k: v.count() for k, v in regress.result_slices(df, "n").items()}
    assert got == {"main": 2, "indices": 4, "samples": 4, "winsorised": 2}


def test_verified_writes(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(100)], "k long, v string")
    path = str(tmp_path / "t")
    io.write_parquet(df, path, 3)
    assert not io.verify(spark, path).first().finished and not audit.table_status(spark, path, ["k"]).first().files_ok
    io.write_verified(df, path, ["k"], 3)
    assert tuple(io.verify(spark, path).first()) == (True, True, True, True, 3, 3, 100)
    assert tuple(audit.table_status(spark, path, ["k"]).first()) == (True, True, 2, True)
    assert spark.read.parquet(path).count() == 100  # the manifest is not read with the data
    part = sorted((tmp_path / "t").glob("part-*.parquet"))
    part[0].rename(tmp_path / "gone")
    found = io.verify(spark, path).first()
    assert (found.finished, found.files_ok, found.files_found) == (True, False, 2)
    one = spark.read.parquet(str(tmp_path / "gone"))
    other = str(tmp_path / "other")
    one.withColumn("v", F.concat(F.substring("v", 2, 9), F.lit("v"))).coalesce(1).write.parquet(other)  # as long, other rows
    (swapped,) = (tmp_path / "other").glob("part-*.parquet")
    swapped.rename(part[0])
    found = io.verify(spark, path).first()
    assert not (found.files_ok and found.rows_ok)


def panel_rows(spark):
    rows = [(i % 5, 2000 + i % 3, float(i % 7), f"b{i % 11}" if i % 13 else None, i, 1.0) for i in range(300)]
    return spark.createDataFrame(rows, "firm long, year int, x double, brand string, job long, w double")


MEASURES = [panel.Measure("jobs", "job", "nunique"), panel.Measure("xs", "x", "nunique"), panel.Measure("brand", "brand", "first"), panel.Measure("last", "brand", "max"), panel.Measure("mean", "x")]


def test_whole_groups_are_not_shuffled_again(spark, monkeypatch):
    """all measures of dealt rows ride in one aggregate where the rows are."""
    monkeypatch.setattr(panel, "TASK_ROWS", 50)
    rows = panel.dealt(panel_rows(spark), "firm", 300)
    assert rows.rdd.getNumPartitions() == 6
    out = panel.build_panel(rows, ["firm", "year"], "w", MEASURES, whole=True)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    apart = panel.build_panel(panel_rows(spark), ["firm", "year"], "w", MEASURES)
    assert out.schema.fieldNames() == apart.schema.fieldNames() and sorted(out.collect()) == sorted(apart.collect())


def test_large_groups_go_apart(spark):
    rows = panel_rows(spark).unionAll(panel_rows(spark).where("firm = 1"))
    ways = []

    def make(large, how, whole):
        ways.append((how, whole))
        kept = rows if large is None else rows.join(large, "firm", how)
        return panel.build_panel(panel.dealt(kept, "firm", 360), ["firm", "year"], "w", MEASURES, whole)

    sizes = rows.groupBy("firm").agg(F.count(F.lit(1)).alias("n"))
    got = panel.by_size(sizes, "firm", make, most=100)
    assert ways == [("left_anti", True), ("left_semi", False)]
    assert sorted(got.collect()) == sorted(panel.build_panel(rows, ["firm", "year"], "w", MEASURES).collect())


def test_distincts_of_levels_are_counted_where_an_entity_is(spark):
    """rows are dealt by entity once for all levels; a null value is a key, a null entity none."""
    rows = [(i % 41 or None, i % 7 or None, i % 3 + 2000) for i in range(400)] + [(None, 9, 2000)]
    out = panel.distinct_by_level(spark.createDataFrame(rows, "e long, p int, y int"), "e", {"parent": "p", "year": "y"}, 400)
    plan = out._jdf.queryExecution().executedPlan().toString()  # from the result down
    assert plan.count("Exchange") == 2 and "Generate" not in plan[plan.index("Exchange hashpartitioning(e#"):]
    want = {("all", "all"): {e for e, *_ in rows}}
    for e, p, y in rows:
        want.setdefault(("parent", None if p is None else str(p)), set()).add(e)
        want.setdefault(("year", str(y)), set()).add(e)
    assert {(r.level, r.key): r.n for r in out.collect()} == {k: len(v - {None}) for k, v in want.items() if v - {None}}


@pytest.mark.parametrize("most", [30, 200_000])
def test_sketches_on_odd_lines(spark, tmp_path, monkeypatch, most):
    """years, orders and prices that are null, prices that are no number or all the same, a large firm: the rows of the SQL."""
    monkeypatch.setattr(panel, "GROUP_ROWS", most)
    con = duckdb.connect()
    con.execute("CREATE VIEW supplier AS SELECT i AS s_suppkey, CASE WHEN i < 8 THEN i % 3 END AS s_nationkey FROM range(9) t(i)")
    con.execute("""CREATE VIEW lineitem AS SELECT CASE WHEN i % 10 < 3 THEN 1 WHEN i % 10 < 9 THEN i % 9 END AS l_suppkey, CASE WHEN i % 9 <> 8 THEN i // 3 END AS l_orderkey,
        CASE WHEN i % 11 > 0 THEN make_timestamp(1992 + i % 4, 3, 1, 0, 0, 0.0) END AS l_shipdate,
        CASE WHEN i % 4 = 1 OR i % 17 = 0 THEN NULL WHEN i % 19 = 0 THEN 'nan'::DOUBLE WHEN i % 4 = 2 THEN 5.0 ELSE i % 90 END AS l_extendedprice FROM range(400) t(i)""")
    for name in ("supplier", "lineitem"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    cur = con.execute(queries.oracle_sql()["a23_sketches"])
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert len(want) == 10 and sum(r[1] is None for r in want) == 2
    got = queries.queries()["a23_sketches"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("most", [0, 12, 10**6])
def test_terms_beyond_the_lookup(lists, monkeypatch, most):
    """weights are the same whether a term is looked up or shuffled, and postings of one list alone are not kept."""
    left, right, a, b = lists
    monkeypatch.setattr(link, "BROADCAST_ROWS", most)
    s = cosines(left, right)
    p, q = link.tfidf_postings(a, b, "k", "j", [])
    sims = p.join(q.withColumnRenamed("w", "v"), ["t1", "t2"]).groupBy("k0", "k1").agg(F.sum(F.col("w") * F.col("v")).alias("s")).collect()
    at, to = {k: i for i, (k, _) in enumerate(left)}, {k: i for i, (k, _) in enumerate(right)}
    assert len(sims) == np.count_nonzero(s) and all(x.s == pytest.approx(s[at[x.k0], to[x.k1]], abs=1e-9) for x in sims)


def test_jaccard_counts_pairs_where_a_row_is(spark):
    """F8: the pairs of a left row are not shuffled."""
    a, b = spark.createDataFrame([(1, "a b c"), (2, "b")], "k long, text string"), spark.createDataFrame([(5, "b c d")], "j long, text string")
    out = link.jaccard(a, b, "k", "j")
    assert not re.search(r"hashpartitioning\(k#\w+, j#", out._jdf.queryExecution().executedPlan().toString())
    assert {(x.k, x.j): x.sim for x in out.collect()} == {(1, 5): 0.5, (2, 5): 1 / 3}


def test_pairs_of_a_small_right_list_are_summed_where_a_row_is(lists, monkeypatch):
    """no levels, bounds or second passes where few postings meet; beyond that the pruned pairs are the same."""
    _, _, a, b = lists
    rows = lambda df: sorted((r.k, r.j or "", round(r.sim, 9)) for r in df.collect())
    pruned = link.similar_pairs
    monkeypatch.setattr(link, "similar_pairs", None)
    got = rows(link.best_matches(a, b, "k", "j", [])), rows(link.matches_above(a, b, "k", "j", []))
    monkeypatch.setattr(link, "similar_pairs", pruned)
    monkeypatch.setattr(link, "PRODUCTS", 0)
    assert got == (rows(link.best_matches(a, b, "k", "j", [])), rows(link.matches_above(a, b, "k", "j", []))) and len(got[1]) > 3


def test_terms_are_counted_by_blocks(lists, monkeypatch):
    """blocks of a few texts send each of their terms once and get its frequency back; no term is shuffled as a row."""
    left, right, a, b = lists
    monkeypatch.setattr(link, "BLOCK_BYTES", 300)
    s = cosines(left, right)
    out, _, sums = link._weighed(a, b, "k", "j", [], "text", True)
    assert not re.search(r"hashpartitioning\(t[12]#", out._jdf.queryExecution().executedPlan().toString())
    p, q = link.tfidf_postings(a, b, "k", "j", [])
    assert sums == (p.count(), q.count(), p.join(q, ["t1", "t2"]).count())
    sims = p.join(q.withColumnRenamed("w", "v"), ["t1", "t2"]).groupBy("k0", "k1").agg(F.sum(F.col("w") * F.col("v")).alias("s")).collect()
    at, to = {k: i for i, (k, _) in enumerate(left)}, {k: i for i, (k, _) in enumerate(right)}
    assert len(sims) == np.count_nonzero(s) and all(x.s == pytest.approx(s[at[x.k0], to[x.k1]], abs=1e-9) for x in sims)


@pytest.mark.parametrize("products", [16, 0])
@pytest.mark.parametrize("name", ["l4_best_match", "l3_threshold"])
def test_matches_of_odd_texts(spark, tmp_path, monkeypatch, name, products):
    """null keys, null, empty and repeated texts, stop words, single letters, digits, marks, other scripts: the rows of the SQL."""
    monkeypatch.setattr(link, "PRODUCTS", products)
    odd = [None, "", " ", "the of", "a b c", "x_1 _ __ 9 42", "ÄRGER ärger Straße", "漢字 漢字かな 🙂🙂 é", "co-op's rock'n'roll", "tab\tline\nend\x00nul x", "Σίσυφος ΟΔΟΣ", "one two", "ONE the two three"]
    rng = random.Random(6)
    words = " ".join(filter(None, odd)).split()
    texts_ = odd + [" ".join(rng.choices(words, k=rng.choice([1, 5, 40]))) for _ in range(40)]
    spark.createDataFrame([(i if i % 17 != 12 else None, t) for i, t in enumerate(texts_)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i if i != 8 else None, t) for i, t in enumerate(texts_[3:25])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    names, want = [c[0] for c in cur.description], cur.fetchall()
    got = [tuple(r) for r in queries.queries()[name](spark, str(tmp_path)).select(*names).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 20


def test_exposure_by_category(spark):
    """sums over tasks are formed for all entities at once; the same rows as by each entity's tasks, with repeated and unknown tasks, codes and entities."""
    rng = random.Random(9)
    cells = spark.createDataFrame([(p, y, o) for p in (1, 2, 3, None) for y in (1, 2) for o in range(6)], "p int, y int, occ int")
    counts = spark.createDataFrame([(p, y, c, rng.randint(0, 9)) for p in (1, 2) for y in (1, 2) for c in range(12) if rng.random() < 0.7] + [(3, 1, 5, 0)], "p int, y int, cat int, n long")
    bridge = spark.createDataFrame([(t, c, rng.random()) for t in range(40) for c in range(14) if rng.random() < 0.3], "task long, cat int, sim double")
    crosswalk = spark.createDataFrame([(0, "a", 0.5), (1, "b", 0.1), (2, "a", 0.9), (3, None, 0.0), (4, "none", 0.3)], "occ int, code string, sim double")
    weights = spark.createDataFrame([(rng.choice("ab"), rng.randint(0, 50), rng.random()) for _ in range(90)], "code string, task long, omega double")
    named = ["p", "y"], "cat", "task", "occ", "code"
    ways = [link.text_exposure(cells, counts, bridge, crosswalk, weights, *named, by_category=x) for x in (True, False)]
    got, want = ({(r.p, r.y, r.occ): tuple(r) for r in w.select(*ways[1].columns).collect()} for w in ways)
    assert got.keys() == want.keys() and len(got) == 48
    assert all(x == pytest.approx(want[k][i], rel=1e-11) if isinstance(x, float) else x == want[k][i] for k, row in got.items() for i, x in enumerate(row))
    assert sum(r[want_at] > 0.01 for r in got.values() for want_at in [ways[1].columns.index("concentration")]) > 8


def test_text_chain_by_category(spark, monkeypatch):
    """the rows of the SQL when sums are formed by category, and no row for each entity and task on the way."""
    from functools import partial

    monkeypatch.setattr(link, "text_exposure", partial(link.text_exposure, by_category=True))
    monkeypatch.setattr(link, "task_exposure", None)
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS FROM '{d}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()["j12_text_chain"])
    names, want = [c[0] for c in cur.description], cur.fetchall()
    rows = [tuple(r) for r in queries.queries()["j12_text_chain"](spark, d).select(*names).collect()]
    assert len(rows) == len(want) and sorted(map(str, rows)) == sorted(map(str, want))
