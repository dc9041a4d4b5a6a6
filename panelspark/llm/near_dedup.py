"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import among, connected_components, load, materialise, released, slices, small_batches

#: Chance that a pair right at the similarity bound has more different values than ``Scheme.distance`` allows.
MISS = 1e-6
#: Members of a rare shingle's main component that all its other members are compared with, before those still apart are paired.
CENTRES = 8
_MULTIPLIERS = np.random.default_rng(2024).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


@dataclass(frozen=True)
class Scheme:
    """A signature of ``chunks`` x ``values`` minhash values of 16 bits, and the most different values of a pair that is looked at.

    A pair with up to ``2 * chunks - 1`` different values has a chunk with at most one error (pigeonhole), and each chunk
    is indexed once for every place where that error may be: all pairs within ``distance`` share a key.
    """

    chunks: int
    values: int
    distance: int

    @property
    def size(self) -> int:
        return self.chunks * self.values


def scheme(percent: int) -> Scheme:
    """The scheme with the longest chunks and then the fewest of them whose guarantee reaches the distance that a similarity of ``percent`` asks for."""
    p = 1 - percent / 100
    for values in (4, 3, 2):
        for chunks in range(4, 65 // values):
            k, tail = chunks * values, 0.0
            d = k
            while d and (tail := tail + comb(k, d) * p**d * (1 - p) ** (k - d)) <= MISS:
                d -= 1
            if d <= 2 * chunks - 1:
                return Scheme(chunks, values, d)
    raise ValueError(f"no signature of 64 values and less for a similarity of {percent} %")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; the whole sequence is one where there are fewer words.

    A-Z is lower-cased and ASCII white space parts words. Nulls and texts without words have empty sets. Each word of
    the batch is hashed once.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    known = words.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known.dictionary.to_pylist()), np.uint64, len(known.dictionary))
    at = known.indices.to_numpy()
    real = (pc.binary_length(known.dictionary).to_numpy(zero_copy_only=False) > 0)[at]  # a text's ends may give empty parts
    h = hashes[at][real]
    starts = np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]

    def combined(h: np.ndarray, n: int, used: int) -> np.ndarray:
        out = np.full(n, used, np.uint64)
        for j in range(used):
            out = _mixed((out ^ h[j : j + n]) * _MIX[j % 5] + np.uint64(j + 1))
        return out

    rolled = combined(h, max(0, len(h) - width + 1), width)
    out = []
    for a, b in zip(starts.tolist(), starts[1:].tolist()):
        if b - a < width:
            out.append(combined(h[a:b], min(1, b - a), b - a))
        else:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
    return out


def _minhashes(s: np.ndarray, size: int) -> np.ndarray:
    low = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):  # long texts in blocks
        low = np.minimum(low, (s[at : at + 1024, None] * _MULTIPLIERS[:size]).min(axis=0))
    return _mixed(low) >> np.uint64(48)


def _keys(values: np.ndarray, kind: Scheme) -> np.ndarray:
    """One key for each chunk and each place in it that is left out, of each row of signature values."""
    chunks = values.reshape(-1, kind.chunks, kind.values)
    out = np.empty(chunks.shape, np.uint64)
    for j in range(kind.values):
        packed = np.arange(kind.chunks, dtype=np.uint64) * np.uint64(kind.values) + np.uint64(j + 1) + np.zeros(chunks.shape[:2], np.uint64)
        for k in range(kind.values):
            if k != j:
                packed = _mixed(packed * np.uint64(0x9E3779B97F4A7C15) ^ chunks[:, :, k])
        out[:, :, j] = packed
    return out.reshape(len(values), kind.size).view(np.int64)


def signatures(docs: DataFrame, width: int, kind: Scheme) -> DataFrame:
    """``doc_id, n_shingles, set_hash, keys, sig`` of each document; no keys and a null hash and signature for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = shingle_sets(batch.column(1), width)
            n = np.array([len(s) for s in sets], np.int64)
            values = np.array([_minhashes(s, kind.size) for s in sets], np.uint64).reshape(-1, kind.size)
            full = n > 0
            keys = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(full * kind.size)]).astype(np.int32), pa.array(_keys(values, kind)[full].ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n), pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), keys,
                    pa.array([v.tobytes() if f else None for v, f in zip(values.astype("<u2"), full, strict=True)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_hash", "keys", "sig"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, keys array<long>, sig binary")


def _near(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Those pairs ``a, b`` whose signatures differ in few enough values and whose set sizes allow the similarity."""
    kind = scheme(percent)
    a, b = (signed.select(F.col("doc_id").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").where(f"{percent} * greatest(n_a, n_b) <= 100 * least(n_a, n_b)").select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, kind.size) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(axis=1) <= kind.distance))

    return both.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``doc_id, shingles`` (sorted 64-bit hashes) of the documents with these ids, each different row once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = [s.tobytes() for s in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    own = among(docs.select(F.col("doc_id").cast("long"), "text"), ids, "doc_id")
    return materialise(own.mapInArrow(run, "doc_id long, shingles binary"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs ``a, b`` whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b").join(
        sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.sort(np.concatenate([x, y]))
                common = int((z[1:] == z[:-1]).sum())
                keep.append(100 * common >= percent * (len(z) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _rare(sets: DataFrame, percent: int) -> DataFrame:
    """``shingle, doc_id, n, most``: the shingles by which all pairs over the similarity bound can be found.

    The shingles of a set are put in order of how many of these sets hold them. Two sets of ``n`` and ``m`` shingles
    over the bound have ``o = ceil(t (n + m) / (1 + t))`` in common, so the first ``n - o + 1`` of the one and the first
    ``m - o + 1`` of the other share one. A shingle's place in its set thus bounds the size of the other set, ``most``.
    So documents that share a core and differ in more than the bound allows do not meet, whatever their number.
    """
    t = percent
    long = materialise(sets.select("doc_id", "shingles").mapInArrow(_unpacked, "doc_id long, n long, shingle long"))
    held = long.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    whole = Window.partitionBy("doc_id")
    rank = F.row_number().over(whole.orderBy("df", "shingle")) + F.col("n") - F.count(F.lit(1)).over(whole)
    ranked = long.join(held, "shingle").withColumn("rank", rank)
    most = F.floor((F.col("n") - F.col("rank") + 1) * (100 + t) / t) - F.col("n")
    first = materialise(ranked.select("shingle", "doc_id", "n", most.alias("most")).where(f"100 * most >= {t} * n"))
    bound = first.groupBy("shingle").agg(F.min("n").alias("least"), F.max("most").alias("far"))
    return first.join(bound, "shingle").where("most >= least and n <= far").drop("least", "far")


def _open(rare: DataFrame, comp: DataFrame) -> DataFrame:
    """The shingles that members of several components hold, with the component ``main`` that most of them are of and ``CENTRES`` of its members."""
    kept = materialise(rare.join(comp, "doc_id"))
    of = kept.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("k"), *(F.min(F.struct(F.xxhash64("doc_id", F.lit(i)), "doc_id")).getField("doc_id").alias(f"c{i}") for i in range(CENTRES)))
    of = of.withColumn("centres", F.array_distinct(F.array(*(f"c{i}" for i in range(CENTRES)))))
    of = of.groupBy("shingle").agg(F.count(F.lit(1)).alias("comps"), F.max_by(F.struct(F.col("comp").alias("main"), "centres"), F.struct("k", "comp")).alias("x")).where("comps > 1")
    return kept.join(of.select("shingle", "x.*"), "shingle")


def _centred(open_: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of each member outside its shingle's main component with a few members of that, drawn by a hash."""
    found = open_.where("comp <> main").select(F.col("doc_id").alias("x"), F.explode("centres").alias("y"))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _sharing_rare(open_: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of different components that share a rare shingle, as all pairs over the similarity bound do; those within the main component are left out."""
    a, b = (open_.select("shingle", F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("most").alias(f"most_{x}"), F.col("comp").alias(f"comp_{x}"), "main") for x in "ab")
    found = a.where("comp_a <> main").drop("main").join(b.drop("main"), "shingle").where("comp_a <> comp_b and n_a <= most_b and n_b <= most_a")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in range(0, batch.num_rows, 500):
            own = batch.slice(part, 500)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in own.column(1)]
            n = np.array([len(s) for s in sets], np.int64)
            ids = np.repeat(own.column(0).to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.repeat(n, n)), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))], ["doc_id", "n", "shingle"])


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least ``percent`` hundredths.

    Returns ``doc_id, n_shingles, component_id`` (the least ``doc_id`` reachable) for each row. Sets are distinct
    ``width``-word shingles; null and empty texts have none and link with nothing. Equal sets are one class before
    anything is joined, whatever their number. Classes that share a key are held against the key's least class; what is
    linked by then is one component. Where a key has further classes of different components, these are paired only
    if they also share a rare shingle (``_rare``), which loses no link: first with a few members of the shingle's main component, so
    that most of a large group is one component, then all that are still apart (``_sharing_rare``). All
    pairs must have near signatures and are then confirmed on their full sets. Rows of one ``doc_id`` are returned one by
    one, each with the component of its own text; rows without ``doc_id`` link with nothing and have no component. Other
    columns are ignored; an empty table gives an empty result.
    """
    with released(docs.sparkSession):
        signed = materialise(signatures(docs, width, scheme(percent)))
        classes = materialise(
            signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_hash")
            .agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("keys", "sig", "n_shingles"), "doc_id").alias("x")).select("set_hash", "doc_id", "x.*")
        )
        keyed = classes.select(F.explode("keys").alias("key"), "doc_id")
        buckets = keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("size")).where("size > 1")
        members = materialise(keyed.join(buckets, "key"))

        def linked(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
            close = materialise(_near(pairs, classes, percent))
            if sets is None:
                sets = _sets(docs, close.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), width)
            return materialise(_confirmed(close, sets, percent))

        links = linked(members.where("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct())
        #: Of keys of three classes and more those that are not the least are not compared with each other yet.
        comp = connected_components(links, "a", "b").withColumnRenamed("node", "doc_id")
        inner = members.where("size > 2 and doc_id <> low").join(comp, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
        inner = materialise(inner)
        open_keys = inner.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("key")
        rest = materialise(inner.join(open_keys, "key").select("doc_id", "comp").distinct())
        sets = _sets(docs, rest.select("doc_id"), width)
        rare = materialise(_rare(sets, percent))
        links = links.unionByName(linked(_centred(_open(rare, rest)), sets))
        comp = connected_components(links, "a", "b").withColumnRenamed("node", "doc_id")
        rest = materialise(rest.select("doc_id").join(comp, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("comp")))
        links = links.unionByName(linked(_sharing_rare(_open(rare, rest)), sets))
        comp = connected_components(links, "a", "b").withColumnRenamed("node", "doc_id")
        moved = classes.select("set_hash", "doc_id").join(comp, "doc_id", "left").select("set_hash", F.coalesce("component", "doc_id").alias("component_id"))
        out = signed.select("doc_id", "n_shingles", "set_hash").join(moved, "set_hash", "left")
        return materialise(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")), keep=True)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents: three-word shingles, similarity of at least 0.85.

    Null, empty and blank texts are components of their own; rows without ``doc_id`` have no component and are kept;
    repeated rows of one ``doc_id`` are returned one by one.
    """
    out = near_duplicates(load(spark, sf_dir, "documents"), width=3, percent=85)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
