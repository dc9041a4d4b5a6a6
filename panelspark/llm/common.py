"""What the corpus operators share: reading tables, shared scratch tables, ranks and components that scale."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read one table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is missing, a local folder becomes the session's checkpoint folder in local mode (tests); on a
    cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            current = tempfile.mkdtemp(prefix="spark-scratch-")
            spark.sparkContext.setCheckpointDir(current)
        base = current
    return base.rstrip("/")


#: Folders of the tables written within each open ``released``, innermost last.
_OPEN: list[list[str]] = []


def materialise(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: cuts lineage, survives lost executors.

    Within ``released`` the table goes at its end, unless ``keep`` hands it to whatever is around that.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/tables/{uuid.uuid4().hex}"
    _note(path, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _note(path: str, keep: bool = False) -> None:
    if len(_OPEN) > keep:
        _OPEN[-1 - keep].append(path)


def bucketed(df: DataFrame, n: int, key: str) -> DataFrame:
    """``materialise`` with rows of one ``key`` in one of ``n`` buckets: later groupings by ``key`` do not shuffle them."""
    spark, name = df.sparkSession, f"scratch_{uuid.uuid4().hex}"
    path = f"{scratch(spark)}/tables/{name}"
    _note(path)
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(name)
    return spark.table(name)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Frees the shared folder of all tables written within it. What outlives it must be written with ``keep``."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            if (name := path.rpartition("/")[2]).startswith("scratch_"):
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of whole texts that go to Python at once at most, which bounds the Arrow buffers of a task.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``TEXT_ROWS`` rows; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches joined and cut so that each has about ``most`` bytes of the text column, or one row; bounds a task's memory."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (size + np.cumsum(sizes)) // most
        cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                held.append(batch.slice(a, b - a))
                size += int(sizes[a:b].sum())
                if b < batch.num_rows or size >= most:
                    yield pa.concat_batches(held)
                    held, size = [], 0
    if held:
        yield pa.concat_batches(held)
    release()


def release() -> None:
    """Give back memory that this Python worker no longer uses: Spark keeps workers for later tasks, side by side with the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems than Linux
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Places of the sieve that tells which rows may have one of some ids: a broadcast table has at most so many rows.
SIEVE = 1 << 21


def among(df: DataFrame, ids: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``key`` is, or with ``inside`` false is not, in the one column of ``ids``; a null key is in none.

    A sieve of hashed ids, bounded by ``SIEVE`` rows, goes to all executors first, so only rows that may have one of the
    ids are shuffled: where these are few, as in all searches here, wide rows stay where they are.
    """
    ids = ids.select(F.col(ids.columns[0]).alias("__id")).where("__id is not null").distinct()
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(SIEVE)).cast("int")
    sieve = F.broadcast(ids.select(place("__id").alias("__place")).distinct())
    placed = df.withColumn("__place", F.when(F.col(key).isNotNull(), place(key)))
    maybe = placed.join(sieve, "__place", "left_semi").drop("__place")
    if inside:
        return maybe.join(ids, maybe[key].cast("long") == ids["__id"].cast("long"), "left_semi")
    surely = placed.join(sieve, "__place", "left_anti").drop("__place")
    return surely.unionByName(maybe.join(ids, maybe[key].cast("long") == ids["__id"].cast("long"), "left_anti"))


def rank_within(df: DataFrame, keys: list[str], order: list[str], out: str, seed: int = 0, pieces: int | None = None) -> DataFrame:
    """Gapless 0-based rank of each row among the rows with equal ``keys``, in a pseudo-random order.

    Each key's rows are dealt to ``pieces`` sub-buckets by a hash of ``order``, ranked there, and moved up by the
    sizes of the sub-buckets before; so a key with a third of all rows is ranked by many tasks. ``order`` should
    identify a row; rows equal in all of it are interchangeable.
    """
    n = pieces or 4 * partitions(df.sparkSession)
    part, before, n_rows, local = (f"__{x}_{out}" for x in ("part", "before", "n", "local"))
    dealt = df.withColumn(part, F.pmod(F.xxhash64(*order, F.lit(seed)), F.lit(n)).cast("int"))
    sizes = dealt.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(n_rows))
    running = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn(before, F.coalesce(F.sum(n_rows).over(running), F.lit(0))).drop(n_rows)
    own = Window.partitionBy(*keys, part).orderBy(F.xxhash64(*order, F.lit(seed + 1)), *order)
    ranked = dealt.withColumn(local, (F.row_number().over(own) - 1).cast("long"))
    return ranked.join(starts, [*keys, part]).withColumn(out, F.col(before) + F.col(local)).drop(part, before, local)


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Smallest node reachable from each node: rows ``(node, component)`` for all nodes that have an edge.

    Alternates large-star and small-star contraction over an edge table that is written to the shared folder each
    round, until no edge changes; edges never come to the driver. Hubs are pre-aggregated by ``min`` before any join.
    """
    e = materialise(
        edges.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v")).where("u <> v").distinct()
    )
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        e = materialise(large.join(low, "u").select(pair.alias("p")).select("p.u", "p.v").where("u <> v").distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
