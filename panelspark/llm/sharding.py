"""Uniform shuffle of a table into shards of exact sizes, by a hypergeometric communication matrix.

Native: DataFrame functions only; the driver sees one count per block.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, partitions, rank_within


def shard_sizes(n_rows: int, n_shards: int) -> list[int]:
    """Sizes of ``n_shards`` shards of ``n_rows`` rows, at most one apart."""
    base, more = divmod(n_rows, n_shards)
    return [base + (i < more) for i in range(n_shards)]


def _log_ratio(k: int, m: int) -> float:
    """``ln(k! / m!)``, without the cancellation that two large logarithms would have."""
    if min(k, m) < 1000:
        return math.lgamma(k + 1) - math.lgamma(m + 1)
    d = k - m
    return (m + 0.5) * math.log1p(d / m) + d * math.log(k) - d + (1 / k - 1 / m) / 12 - (1 / k**3 - 1 / m**3) / 360


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn from ``good + bad`` are good, by ratio of uniforms; numpy's own draw stops at 1e9.

    Stadlober's rejection method; the probabilities relative to the mode are exact to double precision.
    """
    total, few, many = good + bad, min(good, bad), max(good, bad)
    m = min(n, total - n)
    if not m or not few:
        k = 0
    else:
        p = few / total
        centre = m * p + 0.5
        spread = math.sqrt((total - m) * m * p * (1 - p) / max(1, total - 1) + 0.5)
        width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
        mode = (m + 1) * (few + 1) // (total + 2)
        while True:
            u, v = 1 - rng.random(), rng.random()
            k = math.floor(centre + width * (v - 0.5) / u)
            if max(0, m - many) <= k <= min(m, few):
                t = -_log_ratio(k, mode) - _log_ratio(few - k, few - mode) - _log_ratio(m - k, m - mode) - _log_ratio(many - m + k, many - m + mode)
                if 2 * math.log(u) <= t:
                    break
    k = m - k if good > bad else k
    return good - k if m < n else k


def communication_matrix(block_sizes: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """How many rows of each block go to each shard, drawn exactly as a uniform permutation would have it.

    Row by row, a multivariate hypergeometric draw, shard after shard, from what the shards still take. Row sums are
    the block sizes, column sums the shard sizes; any number of rows.
    """
    rng, left, out = np.random.default_rng(seed), list(sizes), []
    for n in block_sizes:
        row, rest = [], sum(left)
        for i, k in enumerate(left):
            rest -= k
            row.append(hypergeometric(rng, k, rest, n))
            n -= row[-1]
            left[i] -= row[-1]
        out.append(row)
    return out


def shuffle_to_shards(df: DataFrame, order: list[str], n_shards: int = 16, seed: int = 42, n_blocks: int | None = None) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard): a uniform shuffle with exact sizes.

    Rows are dealt to blocks by a hash of ``order`` and counted there; the matrix of block-to-shard counts is drawn
    from those counts; each block permutes its rows and cuts them at the matrix row's running sums; each shard
    permutes again for the slots. The driver gets one count for each block (``n_blocks``, four a shuffle partition).

    ``order`` should identify rows: rows equal in all of it share a block. Nulls in it are a value like any other.
    An empty table stays empty; columns of ``df`` named ``shard`` or ``slot`` are replaced. The result is the same
    for the same rows, seed and block count, so a lost executor changes nothing.
    """
    spark = df.sparkSession
    n_blocks = n_blocks or 4 * partitions(spark)
    df = df.drop("shard", "slot")
    dealt = df.withColumn("__block", F.pmod(F.xxhash64(*order, F.lit(seed)), F.lit(n_blocks)).cast("int"))
    counts = {r[0]: r[1] for r in dealt.groupBy("__block").agg(F.count(F.lit(1))).collect()}
    blocks = sorted(counts)
    matrix = communication_matrix([counts[b] for b in blocks], shard_sizes(sum(counts.values()), n_shards), seed)
    values = ", ".join(f"({b}, array({', '.join(f'{x}L' for x in np.cumsum(row)[:-1]) or '-1L'}))" for b, row in zip(blocks, matrix, strict=True))
    if not blocks:
        return df.withColumns({"shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long")}).limit(0)
    cuts = spark.sql(f"SELECT * FROM VALUES {values} AS t(__block, __cuts)")
    permuted = Window.partitionBy("__block").orderBy(F.xxhash64(*order, F.lit(seed + 1)), *order)
    at = (F.row_number().over(permuted) - 1).cast("long")
    placed = (
        dealt.withColumn("__at", at)
        .join(F.broadcast(cuts), "__block")
        .withColumn("shard", F.size(F.filter("__cuts", lambda c: (c <= F.col("__at")) & (c >= 0))).cast("int"))
        .drop("__block", "__cuts", "__at")
    )
    return rank_within(placed, ["shard"], order, "slot", seed=seed + 2)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law ``rows``: counts at most one apart.

    Null text has size 1 and the checksum of no bytes. Repeated rows are dealt one by one; null ids are a value.
    """
    text = F.coalesce("text", F.lit(""))
    rows = load(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return shuffle_to_shards(rows, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
