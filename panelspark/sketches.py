"""Mergeable sketches as columns of a panel: distinct counts and quantiles of fine cells that add up to coarser ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct sketch as a power of 2, and size of a quantile sketch.
LOG_REGISTERS, QUANTILE_SIZE = 14, 800
#: Stated errors: relative, of a distinct count (three standard errors of 1.04 / 2^7), and of a quantile's rank.
DISTINCT_ERROR, RANK_ERROR = 0.025, 0.01


def sketch_panel(df: DataFrame, keys: Sequence[str], distinct: Mapping[str, str] = {}, quantiles: Mapping[str, str] = {}) -> DataFrame:
    """``keys, n`` and a sketch column for each name: HyperLogLog of a column's values, or KLL of its numbers.

    One aggregate; a sketch's size is bounded, whatever the group. Nulls do not count.
    """
    d = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(LOG_REGISTERS)).alias(n) for n, c in distinct.items()]
    q = [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(QUANTILE_SIZE)).alias(n) for n, c in quantiles.items()]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *d, *q)


def merge(panel: DataFrame, keys: Sequence[str], distinct: Sequence[str] = (), quantiles: Sequence[str] = ()) -> DataFrame:
    """The same columns for coarser keys, from the sketches alone: no row of the data is read again."""
    d = [F.hll_union_agg(c).alias(c) for c in distinct]
    q = [F.kll_merge_agg_double(c, F.lit(QUANTILE_SIZE)).alias(c) for c in quantiles]
    return panel.groupBy(*keys).agg(F.sum("n").alias("n"), *d, *q)


def estimates(panel: DataFrame, distinct: Sequence[str] = (), quantiles: Mapping[str, Sequence[float]] = {}) -> DataFrame:
    """Sketch columns replaced by what they say: a count under the same name, quantiles as ``<name>_p<percent>``, null where there was no number."""
    d = {c: F.hll_sketch_estimate(c) for c in distinct}
    at_rank = lambda c, at: F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(float(at))))
    q = {f"{c}_p{round(100 * at):02d}": at_rank(c, at) for c, ats in quantiles.items() for at in ats}
    return panel.withColumns(d | q).drop(*quantiles)
