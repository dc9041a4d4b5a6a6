"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

Native: every step is a DataFrame function on arrays within a row.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, partitions

BINS, BITS, WORDS, PROBES = 256, 4, 5, 12
#: All but the bin's bits: what stands at the end of a bin that no shingle fell into.
_TAIL = (1 << 56) - 1


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _probes(seed: int = 7) -> list[int]:
    """For each bin, the bins that it looks into while empty, in order."""
    rng = random.Random(seed)
    return [j for _ in range(BINS) for j in rng.sample(range(BINS), PROBES)]


def _word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(hashes: Column) -> Column:
    """Hashes of the five-word shingles; of the whole sequence where there are fewer words; none without words."""

    def of(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*(h[i + j] for j in range(WORDS))))
        return F.when(F.size(h) >= WORDS, each).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    return _bind(hashes, of)


def _bins(shingles: Column) -> Column:
    """The least hash of each of the bins, which the top eight bits name; an empty bin holds its own last value.

    One sort does it: with every bin's last value among the hashes, the first of each bin in order is its entry.
    """
    ends = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda b: F.shiftleft(b.cast("long"), 56).bitwiseOR(F.lit(_TAIL)))
    in_order = F.sort_array(F.concat(shingles, ends))
    return _bind(in_order, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(s[F.greatest(i - 1, F.lit(0))], 56))))


def _filled(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_TAIL)) != F.lit(_TAIL)


def _dense(bins: Column) -> Column:
    """Low-order bits of each bin; an empty bin takes the value of the first filled bin in its own order of probes.

    What is taken is hashed with the bin's number before its bits are kept, so that different values that many bins
    take do not agree by chance in all of them at once. Where none of the listed probes is filled, the order goes on by
    the hash of both bins' numbers.
    """
    table = F.split(F.lit(",".join(map(str, _probes()))), ",").cast("array<int>")

    def fill(f: Column) -> Column:
        def rest(b: Column) -> Column:
            by_hash = F.transform(f, lambda x, j: F.when(_filled(x), F.struct(F.xxhash64(b, j).alias("o"), x.alias("x"))))
            return F.array_min(by_hash)["x"]

        def one(x: Column, b: Column) -> Column:
            tries = [F.when(_filled(y), y) for y in (f[table[b * PROBES + t]] for t in range(PROBES))]
            return F.when(_filled(x), x).otherwise(F.xxhash64(F.coalesce(*tries, rest(b)), b)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("byte")

        return F.when(F.exists(f, _filled), F.transform(f, one)).otherwise(F.array().cast("array<byte>"))

    return _bind(bins, fill)


def signature(text: Column) -> Column:
    """Array of ``BINS`` small integers, each the low-order bits of a bin; empty for a text without words or null.

    Depends on nothing but the text. Five-word shingles of the lower-cased text, split at ASCII white space.
    """
    return _dense(_bins(_shingles(_word_hashes(text))))


def packed(sig: Column) -> Column:
    """A signature as hexadecimal digits, one a bin."""
    return F.array_join(F.transform(sig, lambda v: F.substring(F.lit("0123456789abcdef"), v.cast("int") + 1, F.lit(1))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two signatures, without the share of bins that agree by chance; 0 to 1.

    Two empty signatures are alike (1); an empty one and another are not (0).
    """
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    by_chance = 1.0 / (1 << BITS)
    estimate = (same / F.lit(float(BINS)) - by_chance) / (1 - by_chance)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate))).otherwise((F.size(a) == F.size(b)).cast("double"))


def with_next(df: DataFrame, order: str, derived: dict[str, Column]) -> DataFrame:
    """Add ``derived`` columns, and ``next_<column>`` for each of ``df`` and ``derived`` but ``order``: the next row's.

    The next row by ``order``; after the last comes the first. Rows are dealt to ranges of ``order`` whose bounds are
    approximate percentiles (bounds only deal the work), each range is a window of its own, and its last row takes
    the first row of the range after it. Rows of one ``order`` value share a range and follow each other by a hash
    of their other columns; nulls stand last.
    """
    n = 2 * partitions(df.sparkSession)
    plain = [c for c in df.columns if c != order]
    columns = [*plain, *derived]
    tie = F.hash(*plain)
    bounds = sorted(set(df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10000)).first()[0] or []))
    above = F.size(F.filter(F.lit(bounds), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    ranged = F.when(F.col(order).isNull(), n).otherwise(above).cast("int")
    dealt = df.withColumn("__range", ranged)
    # each range's first row: the least value first, over that column alone, then the few rows that have it
    least = dealt.groupBy("__range").agg(F.min(order).alias("__least"))
    first = dealt.join(F.broadcast(least), "__range").where(F.col(order).eqNullSafe(F.col("__least")))
    first = first.withColumns(derived).groupBy("__range").agg(F.min_by(F.struct(*columns), tie).alias("__first"))
    across = Window.orderBy("__range")
    around = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = first.select("__range", F.coalesce(F.lead("__first").over(across), F.first("__first").over(around)).alias("__after"))
    own = Window.partitionBy("__range").orderBy(F.col(order).asc_nulls_last(), tie)
    led = dealt.withColumns(derived).withColumn("__next", F.lead(F.struct(*columns)).over(own)).join(after, "__range")
    following = F.coalesce("__next", "__after")
    return led.withColumns({f"next_{c}": following[c] for c in columns}).drop("__range", "__next", "__after")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how like they are."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs, "doc_id", {"sig": signature(F.col("text"))})
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    out = docs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sig", "next_sig")
    out = out.withColumn("edited_sig", signature(F.col("edited")))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("sig")).alias("fingerprint"),
        packed(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
