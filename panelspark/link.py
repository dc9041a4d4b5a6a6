"""Linking short texts: TF-IDF cosine and token Jaccard over an inverted index, thresholds, best matches, exposure."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import clean
from .io import released, stable
from .panel import BROADCAST_ROWS, TASK_ROWS, small
from .regress import quantiles

#: The columns that name a term: 128 bits of hash, which sort and join faster than texts.
TERM = ("t1", "t2")
#: Levels of how common a term is: half octaves of the product of its frequencies in both lists, which fits 63 bits.
LEVELS = 128
#: Bytes of texts that one task cuts at a time.
BLOCK_BYTES = 4_000_000
#: Postings that meet by term for each left posting, up to which all pairs are summed; beyond that pairs are pruned.
PRODUCTS = 16
#: Pairs of a task for each of its ``TASK_ROWS``.
PAIRS = 4
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits for each pair of hashed words, in order."""
    x = a * _MIX[0] + (b ^ (b >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _cut(rows: pa.Table, stop_words: Sequence[str], bigrams: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's keys and terms (both halves of their names, in order of the first), and its postings: term, key, frequency. Rows of a key are one."""
    keys = rows.column("key").combine_chunks().dictionary_encode("encode")
    words = pc.split_pattern_regex(rows.column("text").combine_chunks(), r"[^\p{L}\p{N}_]+")
    row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    words = words.flatten().dictionary_encode()
    known = words.dictionary
    names = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, known.cast(pa.binary()).to_pylist())), np.uint64).reshape(-1, 2)
    wanted = pc.greater_equal(pc.utf8_length(known), 2).to_numpy(zero_copy_only=False) & ~pc.is_in(known, pa.array(list(stop_words), known.type)).to_numpy(zero_copy_only=False)
    word = words.indices.to_numpy()
    kept = wanted[word]
    word, row = word[kept], row[kept]
    key = keys.indices.to_numpy()[row]
    halves = [names[word, i] for i in (0, 1)]
    if bigrams:
        follows = np.nonzero(row[1:] == row[:-1])[0]
        halves = [np.concatenate([h, _pair(h[follows], h[follows + 1])]) for h in halves]
        key = np.concatenate([key, key[follows]])
    t1, term = np.unique(halves[0], return_inverse=True)
    t2 = np.empty_like(t1)
    t2[term] = halves[1]
    posting, tf = np.unique(term * np.int64(max(1, len(keys.dictionary))) + key, return_counts=True)
    term, key = np.divmod(posting, max(1, len(keys.dictionary)))
    return keys.dictionary, t1, t2, term, key, tf


def _part(t1: np.ndarray, parts: int) -> np.ndarray:
    """The part of all terms that a term is in: ranges of the top 31 bits, so that terms in order have their parts in order."""
    return ((t1 >> np.uint64(33)) * np.uint64(parts) >> np.uint64(31)).astype(np.int64)


def _blobs(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.array([x[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())


def _weighed(left: DataFrame, right: DataFrame, left_key: str, right_key: str, stop_words: Sequence[str], text: str, bigrams: bool) -> tuple[DataFrame, DataFrame, tuple[int, int, int]]:
    """``k0, t1, t2, w`` and ``k1, t1, t2, w``, a row for each key with a term that both lists have and arrays of those; and how many postings they make, left and right, and how many meet.

    Texts are dealt by key to blocks of ``BLOCK_BYTES``. A block sends the terms it has, once each, and how many keys have them, to the parts of all terms,
    and gets the sums back in the same order; so neither terms nor postings are shuffled as rows. Frequencies are counted by the first half of a
    term's name, 64 bits: a billion terms have 0.03 clashes on average.
    """
    spark = left.sparkSession
    lists = [df.select(F.col(k).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text")) for df, k in ((left, left_key), (right, right_key))]
    (n0, size), (n1, more) = (df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first() for df in (left, right))
    n, least = n0 + n1, spark.sparkContext.defaultParallelism
    blocks = [max(least, -(-x // BLOCK_BYTES)) for x in (size, more)]
    parts = max(least, sum(blocks) // 4)
    lists = [df.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(b)).cast("int")) for df, b in zip(lists, blocks, strict=True)]
    stop_words = list(stop_words)

    def found(side: int):
        def count(rows: pa.Table) -> pa.Table:
            _, t1, _, term, _, _ = _cut(rows, stop_words, bigrams)
            own, starts = np.unique(_part(t1, parts), return_index=True)
            ends = [*starts.tolist(), len(t1)]
            held = np.bincount(term, minlength=len(t1)).astype(np.uint32)
            same = [pa.array(np.full(len(own), x, np.int32)) for x in (side, rows.column("block")[0].as_py())]
            return pa.table([*same, pa.array(own.astype(np.int32)), _blobs(t1, ends), _blobs(held, ends)], ["side", "block", "part", "terms", "held"])

        return lists[side].groupBy("block").applyInArrow(count, "side int, block int, part int, terms binary, held binary")

    def total(rows: pa.Table) -> pa.Table:
        terms, held = (rows.column(c).to_pylist() for c in ("terms", "held"))
        ends = np.cumsum([0, *(len(x) // 8 for x in terms)])
        side = np.repeat(rows.column("side").to_numpy(), np.diff(ends))
        held = np.frombuffer(b"".join(held), np.uint32)
        t1, term = np.unique(np.frombuffer(b"".join(terms), np.uint64), return_inverse=True)
        each = [np.bincount(term, weights=held * (side == s), minlength=len(t1)) for s in (0, 1)]
        shared = (each[0] > 0) & (each[1] > 0)
        sums = [int(x[shared].sum()) for x in (each[0], each[1], each[0] * each[1])]
        sums = [pa.array([x] + [0] * (rows.num_rows - 1), pa.int64()) for x in sums]
        df = np.where(shared, -1, 1) * (each[0] + each[1]).astype(np.int64)  # those of shared terms are negative
        return pa.table([rows.column("side"), rows.column("block"), rows.column("part"), _blobs(df.astype(np.int32)[term], ends), *sums], ["side", "block", "part", "df", "s0", "s1", "s2"])

    both = found(0).unionAll(found(1)).groupBy("part").applyInArrow(total, "side int, block int, part int, df binary, s0 long, s1 long, s2 long")
    both = stable(both)
    sums = tuple(int(x) for x in both.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("s0", "s1", "s2"))).first())

    def weigh(rows: pa.Table, counts: pa.Table) -> pa.Table:
        keys, t1, t2, term, key, tf = _cut(rows, stop_words, bigrams)
        df = np.frombuffer(b"".join(counts.sort_by("part").column("df").to_pylist()), np.int32).astype(np.int64)
        w = tf * (np.log((1.0 + n) / (1 + np.abs(df))) + 1)[term]
        norm = np.sqrt(np.bincount(key, weights=w * w, minlength=len(keys)))
        kept = np.nonzero(df[term] < 0)[0]
        kept = kept[np.argsort(key[kept], kind="stable")]
        term, key, w = term[kept], key[kept], w[kept] / norm[key[kept]]
        own, starts = np.unique(key, return_index=True)
        ends = pa.array([*starts.tolist(), len(key)], pa.int32())
        columns = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (t1[term].view(np.int64), t2[term].view(np.int64), w)]
        return pa.table([keys.take(pa.array(own)), *columns], ["key", *TERM, "w"])

    out = []
    for side, df in enumerate(lists):
        kind = df.schema["key"].dataType.simpleString()
        counts = both.where(F.col("side") == side).select("block", "part", "df")
        own = df.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(weigh, f"key {kind}, t1 array<long>, t2 array<long>, w array<double>")
        out.append(own.withColumnRenamed("key", f"k{side}"))
    return out[0], out[1], sums


def _postings(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.inline(F.arrays_zip(*TERM, "w")))


def tfidf_postings(left: DataFrame, right: DataFrame, left_key: str, right_key: str, stop_words: Sequence[str], text: str = "text", bigrams: bool = True) -> tuple[DataFrame, DataFrame]:
    """``k0, t1, t2, w`` and ``k1, t1, t2, w``: the terms that both lists have, with weights of unit length over all of a row's terms.

    Terms are words of two letters or digits and more without stop words, and pairs of neighbours, by ``TERM``. Smooth IDF is fitted on both lists. Norms are sums over all terms; only the shared ones are kept.
    """
    a, b, _ = _weighed(left, right, left_key, right_key, stop_words, text, bigrams)
    return stable(_postings(a, "k0")), stable(_postings(b, "k1"))


def _pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, stop_words: Sequence[str], text: str, least) -> DataFrame:
    """``k0, k1, sim`` of at least all pairs that reach ``least``, a number or a function from both lists' postings to each left row's (``similar_pairs``).

    Where the right list's postings go to all tasks and not many meet a left one, a left row's pairs are summed where it is.
    """
    a, b, (n0, n1, met) = _weighed(left, right, left_key, right_key, stop_words, text, True)
    a, b = a.where("k0 is not null"), stable(_postings(b.where("k1 is not null"), "k1"))
    if n1 <= BROADCAST_ROWS and met <= PRODUCTS * n0:
        n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-met // (PAIRS * TASK_ROWS)))
        a = _postings(a.repartition(n, "k0"), "k0")
        return a.join(F.broadcast(b.withColumnRenamed("w", "w1")), list(TERM)).groupBy("k0", "k1").agg(F.sum(F.col("w") * F.col("w1")).alias("sim"))
    a = stable(_postings(a, "k0"))
    return similar_pairs(a, b, least(a, b) if callable(least) else least)


def tfidf_similarity(left: DataFrame, right: DataFrame, left_key: str, right_key: str, stop_words: Sequence[str], text: str = "text", bigrams: bool = True) -> DataFrame:
    """``left_key, right_key, sim`` of all pairs that share a term: the non-zero cells of the whole matrix.

    Both meet by term; Spark sends a list to all executors where it has measured it to be small.
    """
    a, b = tfidf_postings(left, right, left_key, right_key, stop_words, text, bigrams)
    sims = a.join(b.withColumnRenamed("w", "w1"), list(TERM)).groupBy("k0", "k1").agg(F.sum(F.col("w") * F.col("w1")).alias("sim"))
    return sims.withColumnsRenamed({"k0": left_key, "k1": right_key})


def _levels(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both lists' postings with the ``level`` of their term: the more pairs it makes, the higher."""
    n0, n1 = (x.groupBy(*TERM).agg(F.count(F.lit(1)).alias(c)) for x, c in ((a, "n0"), (b, "n1")))
    level = F.least(F.floor(2 * F.log2(F.col("n0").cast("double") * F.col("n1"))), F.lit(LEVELS - 1)).cast("int")
    table = stable(n0.join(n1, list(TERM)).select(*TERM, level.alias("level")))
    return a.join(table, list(TERM)), stable(b.join(table, list(TERM)))


def similar_pairs(a: DataFrame, b: DataFrame, least: float | DataFrame) -> DataFrame:
    """``k0, k1, sim`` of the pairs of postings (``tfidf_postings``) with at least a similarity: one number, or ``k0, least`` for each left row.

    A row's terms are taken from the rarest level to the most common one. What the common levels can still add to a pair is at
    most the product of both rows' lengths over them. Where that product, with the longest right row, stays under the bound,
    these levels are not probed: a pair over the bound shares a rarer term. Of the pairs found so, those whose sum over rarer
    levels and product over common ones reach the bound get the rest of their terms. A slack of 1e-9 covers rounding. No
    pair over the bound is lost, whatever the lists' sizes.
    """
    a, b = _levels(a, b)
    if isinstance(least, DataFrame):
        a = a.join(least.select("k0", F.col("least").alias("__least")), "k0")
    else:
        a = a.withColumn("__least", F.lit(float(least)))
    upward = lambda k: Window.partitionBy(k).orderBy(F.desc("level")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tail = F.sqrt(F.sum(F.col("w") * F.col("w")).over(upward("k1")))
    longest = {r[0]: r[1] for r in b.withColumn("tail", tail).groupBy("level").agg(F.max("tail")).collect()}  # at most LEVELS rows
    reach = [max((v for k, v in longest.items() if k >= i), default=0.0) for i in range(LEVELS)]
    own = F.sqrt(F.sum(F.col("w") * F.col("w")).over(upward("k0")))
    a = a.withColumn("tail", own)
    left_out = F.col("tail") * F.element_at(F.lit(reach), F.col("level") + 1) < F.col("__least") - 1e-9
    whole = Window.partitionBy("k0")
    a = stable(a.withColumns({"out": left_out, "cut": F.min(F.when(left_out, F.col("level"))).over(whole), "rest": F.max(F.when(left_out, F.col("tail"))).over(whole)}))
    probes = a.where("not out").select("k0", *TERM, "w", "cut", "rest", "__least")
    right = b.select("k1", *TERM, F.col("w").alias("w1"))
    found = probes.join(right, list(TERM)).groupBy("k0", "k1").agg(F.sum(F.col("w") * F.col("w1")).alias("part"), F.max("cut").alias("cut"), F.max("rest").alias("rest"), F.max("__least").alias("__least"))
    squares = b.groupBy("k1", "level").agg(F.sum(F.col("w") * F.col("w")).alias("q")).groupBy("k1").agg(F.collect_list(F.struct("level", "q")).alias("squares"))
    common = F.sqrt(F.aggregate(F.filter("squares", lambda x: x["level"] >= F.col("cut")), F.lit(0.0), lambda s, x: s + x["q"]))
    open_ = found.join(squares, "k1").where(F.col("part") + F.coalesce(F.col("rest") * common, F.lit(0.0)) >= F.col("__least") - 1e-9)
    open_ = stable(open_.select("k0", "k1", "part", "cut", "__least"))
    more = open_.where("cut is not null").select("k0", "k1", "cut").join(b.select("k1", *TERM, "level", F.col("w").alias("w1")), "k1").where("level >= cut")
    more = more.join(a.where("out").select("k0", *TERM, "w"), ["k0", *TERM]).groupBy("k0", "k1").agg(F.sum(F.col("w") * F.col("w1")).alias("more"))
    sims = open_.join(more, ["k0", "k1"], "left").withColumn("sim", F.col("part") + F.coalesce("more", F.lit(0.0)))
    return sims.where(F.col("sim") >= F.col("__least") - 1e-9).select("k0", "k1", "sim")


def _champions(a: DataFrame, b: DataFrame) -> DataFrame:
    """``k0, least``: a similarity that some right row surely has, from the heaviest posting of each term alone."""
    top = b.groupBy(*TERM).agg(F.max(F.struct("w", "k1")).alias("x")).select(*TERM, "x.k1", F.col("x.w").alias("w1"))
    part = a.join(top, list(TERM)).groupBy("k0", "k1").agg(F.sum(F.col("w") * F.col("w1")).alias("s"))
    return part.groupBy("k0").agg(F.max("s").alias("least"))


def matches_above(left: DataFrame, right: DataFrame, left_key: str, right_key: str, stop_words: Sequence[str], q: float = 0.95, floor: float = 0.05, text: str = "text") -> DataFrame:
    """Pairs at least as similar as the ``q`` quantile of the whole matrix, zeros included, and ``floor``: ``left_key, right_key, sim``.

    Only pairs from ``floor`` on are formed. Where the quantile lies among them, its rank is moved by the number of cells
    below; where it does not, ``floor`` decides.
    """
    with released(left.sparkSession):
        n_cells = left.count() * right.count()
        s = stable(_pairs(left, right, left_key, right_key, stop_words, text, floor).where(F.col("sim") >= floor))
        k = s.count()
        at = q * (n_cells - 1) - (n_cells - k)
        tau = quantiles(s, "sim", [min(1.0, at / max(1, k - 1))])[0] if at >= 0 and k else floor
        out = s.where(F.col("sim") >= max(tau, floor)).withColumnsRenamed({"k0": left_key, "k1": right_key})
        return stable(out, keep=True)


def best_matches(left: DataFrame, right: DataFrame, left_key: str, right_key: str, stop_words: Sequence[str], text: str = "text", digits: int = 9) -> DataFrame:
    """The most similar right row of each left row, the least id of those equal to ``digits``: ``left_key, right_key, sim, matched``.

    A left row without a shared term has a null match and ``matched`` 0. A first pass over the heaviest postings gives each left row a similarity that some right row
    reaches; only pairs that can reach it are formed.
    """
    with released(left.sparkSession):
        least = lambda a, b: stable(_champions(a, b).withColumn("least", F.col("least") - 2 * 10.0**-digits))
        sims = _pairs(left, right, left_key, right_key, stop_words, text, least).withColumnsRenamed({"k0": left_key, "k1": right_key})
        return stable(best_match(left, sims, left_key, right_key, digits), keep=True)


def _token_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n, w``: the distinct runs of a-z and 0-9 of the lower-cased text."""
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != ""))
    return df.select(key, words.alias("w")).select(key, F.size("w").alias("n"), "w")


def jaccard(left: DataFrame, right: DataFrame, left_key: str, right_key: str, text: str = "text") -> DataFrame:
    """Token-set Jaccard of all pairs that share a token: the non-zero cells of the whole matrix."""
    tokens = lambda t, key, n: _token_sets(t, key, text).select(key, F.col("n").alias(n), F.explode("w").alias("token"))
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-left.count() * right.count() // (PAIRS * TASK_ROWS)))
    dealt = left.select(left_key, text).repartition(n, left_key)  # a row's pairs are counted where it is
    both = tokens(dealt, left_key, "na").join(small(tokens(right, right_key, "nb")), "token").groupBy(left_key, right_key, "na", "nb").agg(F.count(F.lit(1)).alias("common"))
    return both.select(left_key, right_key, (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("sim"))


def jaccard_above(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: float, text: str = "text") -> DataFrame:
    """Pairs with a token-set Jaccard of at least ``least``, over 0: ``left_key, right_key, sim``.

    The tokens of a set are put in order: those that the right list lacks, then from the rarest to the most common. A pair over
    the bound has at least ``least * n`` of the ``n`` tokens of either set in common, so both sets' first ``n - ceil(least * n) + 1``
    tokens share one; and the sizes are within the bound of each other. A left set's tokens that the right list lacks come first but
    make no pair, so they are only counted. Only such pairs are formed, once, and then compared by all tokens that both lists have.
    """
    with released(left.sparkSession):
        whole = stable(_token_sets(right, right_key, text).select(F.col(right_key).alias("k1"), "n", "w").where("n > 0"))
        words = stable(whole.select(F.explode("w").alias("token")).distinct())
        rows = _token_sets(left, left_key, text).withColumn("row", F.monotonically_increasing_id()).select(F.col(left_key).alias("k0"), "row", "n", F.explode("w").alias("token"))
        rows = rows.join(small(words), "token").groupBy("k0", "row", "n").agg(F.collect_list("token").alias("w"))
        need = lambda n: F.ceil(least * n - 1e-9)
        sets = [stable(rows.where(F.size("w") >= need(F.col("n")))), whole.withColumn("row", F.monotonically_increasing_id())]
        held = sets[0].select(F.explode("w").alias("token")).unionAll(sets[1].select(F.explode("w").alias("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        held = small(stable(held))
        first = []
        for s, k in zip(sets, ("k0", "k1"), strict=True):
            at = F.row_number().over(Window.partitionBy(k, "row").orderBy("df", "token"))
            own = s.select(k, "row", F.col("n").alias(f"n_{k}"), F.size("w").alias("m"), F.explode("w").alias("token"))
            first.append(own.join(held, "token").withColumn("at", at).where(F.col("at") <= F.col("m") - need(F.col(f"n_{k}")) + 1).select(k, f"n_{k}", "token"))
        near = (F.col("n_k1") >= least * F.col("n_k0") - 1e-9) & (F.col("n_k0") >= least * F.col("n_k1") - 1e-9)
        pairs = first[0].join(first[1], "token").where(near).select("k0", "k1").distinct()
        common = F.size(F.array_intersect("w0", "w1"))
        sims = pairs.join(sets[0].select("k0", F.col("n").alias("n0"), F.col("w").alias("w0")), "k0").join(sets[1].select("k1", F.col("n").alias("n1"), F.col("w").alias("w1")), "k1")
        sims = sims.select(F.col("k0").alias(left_key), F.col("k1").alias(right_key), (common / (F.col("n0") + F.col("n1") - common)).alias("sim"))
        return stable(sims.where(F.col("sim") >= least), keep=True)


def above_threshold(sims: DataFrame, n_cells: int, q: float = 0.95, floor: float = 0.05) -> DataFrame:
    """Pairs at least as similar as the ``q`` quantile of the whole matrix, zeros included, and ``floor``.

    The quantile of all cells is found among the non-zero ones: their rank is moved by the number of zeros.
    """
    s = stable(sims.where("sim > 0"))
    k, low = s.agg(F.count(F.lit(1)), F.min("sim")).first()
    at = q * (n_cells - 1) - (n_cells - k)
    if at < 0 or not k:
        tau = max(0.0, (low or 0.0) * (at + 1)) if at > -1 else 0.0
    else:
        tau = quantiles(s, "sim", [min(1.0, at / max(1, k - 1))])[0]
    return s.where(F.col("sim") >= max(tau, floor))


def best_match(left: DataFrame, sims: DataFrame, left_key: str, right_key: str, digits: int = 9) -> DataFrame:
    """The most similar right row of each left row, the least id of those equal to ``digits``; null and ``matched`` 0 where none shares a term."""
    order = F.struct(-F.round("sim", digits), right_key)
    top = sims.groupBy(left_key).agg(F.min_by(F.struct(right_key, "sim"), order).alias("__top")).select(left_key, "__top.*")
    return left.select(left_key).join(top, left_key, "left").select(left_key, right_key, F.coalesce("sim", F.lit(0.0)).alias("sim"), F.when(F.col("sim") > 0, 1).otherwise(0).alias("matched"))


def task_weights(df: DataFrame, occupation: str, rating: str, out: str = "omega") -> DataFrame:
    """Share of a rating within the occupation; missing ratings count 1, negative ones 0."""
    r = F.greatest(F.coalesce(F.col(rating).cast("double"), F.lit(1.0)), F.lit(0.0))
    return df.withColumn(out, F.try_divide(r, F.sum(r).over(Window.partitionBy(occupation))))


def task_exposure(counts: DataFrame, bridge: DataFrame, entity: Sequence[str], category: str, task: str) -> tuple[DataFrame, DataFrame]:
    """``(tasks, totals)``: an entity's exposure of each task, ``xi``, and its similarity-weighted twin, ``xi_sim``; its total count.

    ``counts``: entity, category, n. ``bridge``: category, task, sim and exposed (0/1), many to many.
    """
    totals = counts.groupBy(*entity).agg(F.sum("n").alias("total"))
    sums = counts.join(bridge, category).groupBy(*entity, task).agg(F.sum(F.col("n") * F.col("exposed")).alias("a"), F.sum(F.col("n") * F.col("sim")).alias("b"))
    tasks = sums.join(totals, list(entity)).select(*entity, task, F.try_divide("a", "total").alias("xi"), F.try_divide("b", "total").alias("xi_sim"))
    return tasks, totals


def exposure(cells: DataFrame, tasks: DataFrame, totals: DataFrame, entity: Sequence[str], weights: DataFrame, occupation: str, task: str) -> DataFrame:
    """Average and concentration of task exposure in each cell, and the average of the twin, each also times log1p of the total.

    ``cells``: entity, occupation; ``tasks``: entity, task, xi and, if there is one, xi_sim; ``totals``: entity, total;
    ``weights``: occupation, task, omega. Equi-joins only: tasks that an entity lacks have no exposure and count through
    the sum of an occupation's weights alone.
    """
    twin = "xi_sim" if "xi_sim" in tasks.columns else "xi"
    w, x = F.col("omega"), F.col("xi")
    met = tasks.join(weights, task).groupBy(*entity, occupation).agg(F.sum(w * x).alias("s1"), F.sum(w * x * x).alias("s2"), F.sum(w * F.col(twin)).alias("twin"))
    return _averages(cells, met, totals, entity, weights, occupation)


def _averages(cells: DataFrame, met: DataFrame, totals: DataFrame, entity: Sequence[str], weights: DataFrame, occupation: str) -> DataFrame:
    """``exposure`` from each entity's and occupation's sums over tasks: weighted exposures, their squares, and the twin."""
    whole = weights.groupBy(occupation).agg(F.sum("omega").alias("sw"))
    out = cells.join(whole, occupation, "left").join(met, [*entity, occupation], "left").join(totals, list(entity), "left")
    out = clean.fill(out, {"s1": 0.0, "s2": 0.0, "twin": 0.0, "sw": 0.0, "total": 0.0})
    spread = F.greatest(F.col("s2") - 2 * F.col("s1") * F.col("s1") + F.col("s1") * F.col("s1") * F.col("sw"), F.lit(0.0))
    out = out.select(*entity, occupation, F.col("s1").alias("average"), spread.alias("concentration"), F.col("twin").alias("twin_average"), "total")
    return out.withColumns({f"{c}_scaled": F.col(c) * F.log1p("total") for c in ("average", "concentration", "twin_average")})


def _met_by_category(counts: DataFrame, bridge: DataFrame, totals: DataFrame, weights: DataFrame, entity: Sequence[str], category: str, task: str, occupation: str) -> DataFrame:
    """``s1, s2, twin`` of each entity and occupation (``_averages``) without a row for each entity and task.

    An exposure is a sum over categories of the entity's share, so weighted sums over tasks are formed once for all entities: of each
    category, and for the squares of each two categories that a task has; shares come to these sums only.
    """
    own = bridge.groupBy(task).agg(F.collect_list(F.struct(F.col(category).alias("c"), "sim")).alias("has"))
    linked = own.join(weights.select(occupation, task, "omega"), task).select(occupation, "omega", "has", F.explode("has").alias("x"))
    linked = linked.select(occupation, "omega", "x.c", F.col("x.sim").alias("sim"), F.filter("has", lambda y: y["c"] >= F.col("x.c"))["c"].alias("with"))
    one = linked.groupBy(occupation, "c").agg(F.sum("omega").alias("u"), F.sum(F.col("omega") * F.col("sim")).alias("v"))
    two = linked.select(occupation, "omega", "c", F.explode("with").alias("d")).groupBy(occupation, "c", "d").agg(F.sum(F.col("omega") * F.when(F.col("c") == F.col("d"), 1).otherwise(2)).alias("m"))
    share = stable(counts.groupBy(*entity, F.col(category).alias("c")).agg(F.sum("n").alias("n")).join(totals, list(entity)).select(*entity, "c", F.try_divide("n", "total").alias("share")))
    share = small(share)
    firsts = one.join(share, "c").groupBy(*entity, occupation).agg(F.sum(F.col("u") * F.col("share")).alias("s1"), F.sum(F.col("v") * F.col("share")).alias("twin"))
    again = share.select(*entity, F.col("c").alias("d"), F.col("share").alias("share_d"))
    squares = two.join(share, "c").join(again, [*entity, "d"]).groupBy(*entity, occupation).agg(F.sum(F.col("m") * F.col("share") * F.col("share_d")).alias("s2"))
    return firsts.join(squares, [*entity, occupation])


def _fewer_by_category(bridge: DataFrame, totals: DataFrame, weights: DataFrame, category: str, task: str, occupation: str) -> bool:
    """Whether ``_met_by_category`` meets fewer rows than each entity's exposure of each task."""
    n, two = bridge.groupBy(task).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") + 1) / 2)).first()
    n_categories, n_entities, n_occupations = bridge.select(category).distinct().count(), totals.count(), weights.select(occupation).distinct().count()
    return bool(n) and two + min(two, n_occupations * n_categories * (n_categories + 1) / 2) * n_entities < n * n_entities


def text_exposure(
    cells: DataFrame, counts: DataFrame, bridge: DataFrame, crosswalk: DataFrame, weights: DataFrame, entity: Sequence[str], category: str, task: str, occupation: str, code: str, by_category: bool | None = None
) -> DataFrame:
    """The exposure chain over linked texts: categories to tasks by ``bridge``, occupations to codes by ``crosswalk``, codes to tasks by ``weights``.

    ``cells``: entity, occupation; ``counts``: entity, category, n; ``bridge``: category, task, sim (``matches_above``);
    ``crosswalk``: occupation, code, sim (``best_matches``); ``weights``: code, task, omega. Exposure is computed once for
    each entity and code and goes to all occupations of the code by an equi-join; an occupation without a code has none.
    ``by_category``: form sums over tasks for all entities at once (``_met_by_category``); by default, where that meets fewer rows.
    """
    with released(cells.sparkSession):
        counts = stable(counts)
        coded = stable(cells.join(crosswalk.select(occupation, code, F.col("sim").alias("match_sim")), occupation, "left"))
        asked = coded.where(F.col(code).isNotNull()).select(*entity, code).distinct()
        totals = counts.groupBy(*entity).agg(F.sum("n").alias("total"))
        if _fewer_by_category(bridge, totals, weights, category, task, code) if by_category is None else by_category:
            found = _averages(asked, _met_by_category(counts, bridge, totals, weights, entity, category, task, code), totals, entity, weights, code)
        else:
            tasks, totals = task_exposure(counts, bridge.withColumn("exposed", F.lit(1)), entity, category, task)
            found = exposure(asked, tasks, totals, entity, weights, code, task)
        out = coded.join(found.drop("total"), [*entity, code], "left").join(totals, list(entity), "left")
        return stable(clean.fill(out, {c: 0.0 for c in [*found.columns, "total", "match_sim"] if c not in (*entity, code)}), keep=True)


def match_diagnostics(matches: DataFrame) -> DataFrame:
    """``n, n_matched, mean_sim, low_sim, high_sim`` of a table of best matches; similarities are of the matched rows."""
    own = F.when(F.col("matched") == 1, F.col("sim"))
    return matches.agg(F.count(F.lit(1)).alias("n"), F.count(own).alias("n_matched"), F.avg(own).alias("mean_sim"), F.min(own).alias("low_sim"), F.max(own).alias("high_sim"))


def rated_tasks(tasks: DataFrame, ratings: DataFrame, occupations: DataFrame, task: str, occupation: str) -> DataFrame:
    """Tasks with their ratings and their occupations' titles, both as far as they are known."""
    return tasks.join(ratings, [occupation, task], "left").join(occupations, occupation, "left")
