"""Embedding near-dedup: coarse inverted lists, product-quantised residuals, sufficient probes, exact cosine rerank."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, load, materialise, released

#: Vectors that codebooks are fitted on at most, subspaces, codes in each, and rows and bytes of a block of lists, or of queries, at most.
SAMPLE, SUBSPACES, CODES, BLOCK, BLOCK_BYTES = 12_000, 8, 64, 16_384, 16_000_000
#: Queries that a block of lists is compared with at a time.
STEP = 1024
#: Rows of a layout that is sent to all executors at most.
LAYOUT_ROWS = 500_000
#: Rows that a list of the largest label should have. Eight sampled vectors a list are the least that centroids are fitted on; beyond that lists grow.
CELL = 512


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)[0]
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _compact(c: np.ndarray) -> np.ndarray:
    """Centroids in an order in which near ones follow each other, so that a block of lists in turn lies in one place."""
    return c[np.argsort(_nearest(c, _kmeans(c, math.isqrt(len(c)) or 1))[0], kind="stable")]


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)
    return d.argmin(1), d


class Index:
    """Coarse centroids and residual codebooks; all distances are between unit vectors."""

    def __init__(self, sample: np.ndarray, n_lists: int):
        self.coarse = _compact(_kmeans(sample, n_lists))
        rest = sample - self.coarse[_nearest(sample, self.coarse)[0]]
        parts = np.split(rest, SUBSPACES, axis=1)
        self.books = [_kmeans(p, CODES, seed=i + 1) for i, p in enumerate(parts)]
        self.between = np.sqrt(_nearest(self.coarse, self.coarse)[1])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and distance to the decoded vector."""
        near = _nearest(x, self.coarse)[0]
        rest = x - self.coarse[near]
        codes = np.stack([_nearest(p, b)[0] for p, b in zip(np.split(rest, SUBSPACES, axis=1), self.books, strict=True)], axis=1)
        return near, codes.astype(np.uint8), np.linalg.norm(rest - self._decoded(codes), axis=1)

    def _decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Which lists can hold a vector within ``radius``: those whose bounding plane is not farther than that; and squared distances to all centroids."""
        near, d = _nearest(x, self.coarse)
        own = d[np.arange(len(near)), near][:, None]
        return (d - own) <= 2 * self.between[near] * (radius + 1e-9) + 1e-9, d

    def own_part(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What a coded vector adds to its squared distance from any query, besides the centroid's and the looked up products."""
        decoded = self._decoded(codes)
        return 2 * np.einsum("ij,ij->i", self.coarse[lists], decoded) + (decoded * decoded).sum(1)

    def products(self, q: np.ndarray) -> list[np.ndarray]:
        """Products of queries, as columns, with each code of each subspace: the tables that distances are looked up in."""
        return [(b @ p.T).astype(np.float32) for p, b in zip(np.split(q, SUBSPACES, axis=1), self.books, strict=True)]


def _lookup(tables: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Products of the coded vectors' rests, as rows, with queries: a sum over subspaces."""
    out = tables[0][codes[:, 0]]
    for i, t in enumerate(tables[1:], 1):
        out += t[codes[:, i]]
    return out


def vector_links(vectors: DataFrame, threshold: float = 0.93, n_lists: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id`` for each vector: links of equal label with cosine of ``threshold`` or more.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with
    nothing. Vectors of different lengths are never compared. Equal vectors of a label are one class with a count.
    Centroids and codebooks are fitted on a bounded sample (``SAMPLE``); every class is indexed, each is a query, and
    it probes every list that can hold a link. Lookup distances less the coding error bound the true ones, so no link
    is lost; what remains is compared by exact cosine. A label's lists are dealt in turn to blocks of ``BLOCK`` rows, a
    query goes once to each block that holds a list it probes, and links leave a block as counts and a spanning star,
    never as all pairs. Rows that are shuffled are those of a label times its number of blocks.
    """
    with released(vectors.sparkSession):
        return materialise(_links(vectors, threshold, n_lists), keep=True)


def _links(vectors: DataFrame, threshold: float, n_lists: int | None) -> DataFrame:
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))

    def unit(batches):
        for batch in batches:
            dims, data, sets = [], [], []
            for v in batch.column(2):
                v = v.as_py()
                ok = bool(v) and None not in v
                x = np.array(v if ok else [], dtype=np.float64)
                scale = np.abs(x).max(initial=0.0)
                if not ok or not np.isfinite(x).all() or not scale:
                    dims.append(None), data.append(None), sets.append(None)
                    continue
                x = x / scale
                dims.append(len(x)), data.append((x / np.linalg.norm(x)).tobytes())
                sets.append(xxhash.xxh128_digest(np.array(v, dtype=np.float64).tobytes()))
            cols = [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(data, pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "dim", "vec", "set_hash"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    rows = materialise(rows.mapInArrow(unit, "vec_id long, label string, dim int, vec binary, set_hash binary"))
    whole = rows.where("vec is not null and label is not null and vec_id is not null")
    classes = whole.groupBy("label", "dim", "set_hash").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.min_by("vec", "vec_id").alias("vec"))
    classes = materialise(classes)
    n, widest = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not n:
        return alone
    width = -(-widest // SUBSPACES) * SUBSPACES

    def matrix(column) -> np.ndarray:
        out = np.zeros((len(column), width))
        for i, v in enumerate(column):
            x = np.frombuffer(v.as_py() if hasattr(v, "as_py") else v, np.float64)
            out[i, : len(x)] = x
        return out

    drawn = classes.select("rep").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE)
    sample = classes.join(F.broadcast(drawn), "rep", "left_semi").orderBy("rep").select("vec").limit(SAMPLE).collect()
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    index = Index(matrix([bytes(r[0]) for r in sample]), n_lists or int(min(SAMPLE // 8, max(4, largest / CELL))))

    def indexed(batches):
        for batch in batches:
            if batch.num_rows:
                near, codes, error = index.encode(matrix(batch.column(4)))
                more = [pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in codes]), pa.array(error)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "list", "codes", "error"])

    def probing(batches):
        for batch in batches:
            if batch.num_rows:
                probes = [np.nonzero(p)[0].astype(np.int32) for p in index.probes(matrix(batch.column(3)), radius)[0]]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probes, pa.list_(pa.int32()))], [*batch.schema.names, "probes"])

    schema = "label string, dim int, rep long, m long, vec binary, list int, codes binary, error double"
    coded = materialise(classes.select("label", "dim", "rep", "m", "vec").mapInArrow(indexed, schema))
    cell, of = ["label", "dim", "list"], ["label", "dim"]
    block = max(1, min(BLOCK, BLOCK_BYTES // (8 * width)))
    in_turn = Window.partitionBy(*of).orderBy("list").rowsBetween(Window.unboundedPreceding, -1)
    cells = coded.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(in_turn), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(*of)))
    cells = materialise(cells.withColumn("blocks", F.ceil(F.col("total") / block).cast("int")))
    at = lambda place: F.floor(place * F.col("blocks") / F.col("total")).cast("int")
    spans = cells.select(*of, "list", "blocks", F.explode(F.sequence(at(F.col("before")), at(F.col("before") + F.col("n") - 1))).alias("bs"))
    blocks = materialise(spans.groupBy(*of, "bs").agg(F.min("list").alias("low"), F.max("list").alias("high"), F.max("blocks").alias("blocks")))
    sent = lambda t: F.broadcast(t) if t.count() <= LAYOUT_ROWS else t
    base = coded.join(sent(cells), cell).withColumn("bs", at(F.col("before") + F.pmod(F.xxhash64("rep"), F.col("n")))).withColumn("qs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    base = base.drop("n", "before", "total", "blocks")
    asked = coded.select("label", "dim", "rep", "vec").mapInArrow(probing, "label string, dim int, rep long, vec binary, probes array<int>")
    asking = asked.join(sent(blocks), of).where(F.exists("probes", lambda p: p.between(F.col("low"), F.col("high")))).withColumn("qs", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    keys = ["label", "dim", "bs", "qs"]
    asking = asking.select(*(F.col(c).alias(c) for c in [*keys, "rep", "vec"]))  # other columns than base's, for the cogroup

    def pairs(qv: np.ndarray, bv: np.ndarray, lists: np.ndarray, codes: np.ndarray, reach: np.ndarray):
        """Places of queries and of rows whose cosine reaches the threshold; ``lists`` is in order."""
        own = index.own_part(lists, codes) - reach
        ends = [*np.nonzero(np.diff(lists, prepend=-1))[0].tolist(), len(lists)]
        for s in range(0, len(qv), STEP):
            q = qv[s : s + STEP]
            probes, d = index.probes(q, radius)
            tables = index.products(q)
            for a, b in zip(ends, ends[1:]):
                some = np.nonzero(probes[:, lists[a]])[0]
                few = [t[:, some] for t in tables]
                far = d[some, lists[a]]
                for c in range(a, b, STEP):
                    rows = slice(c, min(b, c + STEP))
                    bi, qi = np.nonzero(2 * _lookup(few, codes[rows]) >= (own[rows, None] + far).astype(np.float32) - np.float32(1e-5))
                    bi, qi = bi + c, some[qi] + s
                    for e in range(0, len(qi), 65536):
                        x, y = qi[e : e + 65536], bi[e : e + 65536]
                        good = np.einsum("ij,ij->i", qv[x], bv[y]) >= threshold
                        yield x[good], y[good]

    def link(q: pa.Table, b: pa.Table) -> pa.Table:
        kind, left, right = [], [], []
        if q.num_rows and b.num_rows:
            b = b.sort_by("list")
            qv, bv = matrix(q.column("vec")), matrix(b.column("vec"))
            qid, bid, m = (t.column(c).to_numpy() for t, c in ((q, "rep"), (b, "rep"), (b, "m")))
            codes = np.frombuffer(b"".join(c.as_py() for c in b.column("codes")), np.uint8).reshape(-1, SUBSPACES)
            found = list(pairs(qv, bv, b.column("list").to_numpy(), codes, (radius + 1e-6 + b.column("error").to_numpy()) ** 2))
            qi, bi = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
            other = qid[qi] != bid[bi]
            qi, bi = qi[other], bi[other]
            if len(qi):
                found = np.bincount(qi, weights=m[bi], minlength=len(qid)).astype(np.int64)
                asked_by = np.nonzero(found)[0]
                ql, bl, before = qid.copy(), bid.copy(), None
                while before is None or before != (int(ql.sum()), int(bl.sum())):
                    before = (int(ql.sum()), int(bl.sum()))
                    np.minimum.at(ql, qi, bl[bi])
                    np.minimum.at(bl, bi, ql[qi])
                kind = [0] * len(asked_by)
                left, right = qid[asked_by].tolist(), found[asked_by].tolist()
                nodes, low = np.concatenate([qid, bid]), np.concatenate([ql, bl])
                moved = nodes != low
                kind += [1] * int(moved.sum())
                left += nodes[moved].tolist()
                right += low[moved].tolist()
        return pa.table([pa.array(kind, pa.int32()), pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["kind", "a", "b"])

    found = materialise(asking.groupBy(*keys).cogroup(base.groupBy(*keys)).applyInArrow(link, "kind int, a long, b long"))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    comps = connected_components(found.where("kind = 1"), "a", "b").withColumnRenamed("node", "rep")
    of_class = classes.select("label", "dim", "set_hash", "rep", "m").join(counts, "rep", "left").join(comps, "rep", "left")
    of_class = of_class.select("label", "dim", "set_hash", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.join(of_class, ["label", "dim", "set_hash"], "left")
    known = F.col("vec_id").isNotNull()
    return out.select("vec_id", F.when(known, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(known, F.coalesce("c", "vec_id")).alias("component_id"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings, within labels, at cosine 0.93.

    Null, empty, zero and non-finite vectors and those without label stand alone; rows without ``vec_id`` link with
    nothing, have no component and are kept; each repeated row counts as a vector of its own.
    """
    out = vector_links(load(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
