"""Sources and sinks: tables in, panels and reports out."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, path: str, recursive: bool = False, schema: T.StructType | None = None, legacy_calendar: bool = False) -> DataFrame:
    """Scan Parquet; ``recursive`` also takes files in folders below. The vectorised reader stays on.

    ``legacy_calendar`` reads dates and timestamps, 96-bit ones too, that were written by the old hybrid calendar.
    """
    reader = spark.read.option("recursiveFileLookup", recursive)
    if legacy_calendar:
        reader = reader.option("datetimeRebaseMode", "LEGACY").option("int96RebaseMode", "LEGACY")
    return (reader.schema(schema) if schema else reader).parquet(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text with a header, all strings; header names lose blanks and a byte-order mark."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def write_parquet(df: DataFrame, path: str, files: int | None = None) -> None:
    """Overwrite a snappy Parquet table, in ``files`` files if given; rows are dealt anew so that upstream stays wide."""
    (df.repartition(files) if files else df).write.mode("overwrite").option("compression", "snappy").parquet(path)


#: Folder in a table's own folder that holds its manifest; readers of the table pass over it.
MANIFEST = "_manifest"


def _checksum() -> list:
    """Row count and an order-free sum of row hashes, for ``agg``."""
    return [F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.col("__h").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("checksum")]


def _by_file(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``file, bytes, n_rows, checksum`` of a table that was read from files."""
    return df.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.xxhash64(*columns).alias("__h")).groupBy("file", "bytes").agg(*_checksum())


def write_verified(df: DataFrame, path: str, keys: Sequence[str] = (), files: int | None = None) -> None:
    """``write_parquet``, then a manifest beside the data: bytes, rows and checksum of each file, and the table's distinct ``keys``.

    The manifest is made from what is read back and written last, so a table without one is unfinished.
    """
    spark = df.sparkSession
    write_parquet(df, path, files)
    there = spark.read.parquet(path)
    n_keys = there.select(*keys).distinct().count() if keys else None
    manifest = _by_file(there, there.columns).withColumns({"columns": F.lit(there.schema.simpleString()), "keys": F.lit(",".join(keys)), "n_keys": F.lit(n_keys).cast("long")})
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{MANIFEST}")


def verify(spark: SparkSession, path: str, rows: bool = True) -> DataFrame:
    """One row on a table and its manifest: ``finished, files_ok, rows_ok, keys_ok, files_expected, files_found, n_rows``.

    ``files_ok``: the same files of the same bytes are there, from a listing alone. ``rows_ok``: rows and checksums of every file
    agree, and ``keys_ok``: the keys are as many as were written, and rows no more; with ``rows`` false both are null and no row
    is read. A table without a manifest is not finished, and nothing else of it is known.
    """
    names = "finished boolean, files_ok boolean, rows_ok boolean, keys_ok boolean, files_expected long, files_found long, n_rows long"
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{MANIFEST}/_SUCCESS")
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([(False, None, None, None, None, None, None)], names)
    manifest = spark.read.parquet(f"{path.rstrip('/')}/{MANIFEST}")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(path).select(F.col("_metadata.file_name").alias("file"), F.col("length").alias("found"))
    listed = listed.where(F.col("file").endswith(".parquet"))
    both = manifest.join(listed, "file", "full_outer")
    files = both.agg(
        (F.count_if(~(F.col("bytes").eqNullSafe(F.col("found")))) == 0).alias("files_ok"), F.count("bytes").alias("files_expected"), F.count("found").alias("files_found"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.max("keys").alias("keys"), F.max("n_keys").alias("n_keys"), F.max("columns").alias("columns"),
    ).first()
    rows_ok = keys_ok = None
    if rows and files.files_ok:
        there = spark.read.parquet(path)
        now = _by_file(there, there.columns).select("file", F.col("n_rows").alias("rows_now"), F.col("checksum").alias("sum_now"))
        # a file without rows is in neither
        differs = F.count_if(~((F.col("n_rows").eqNullSafe(F.col("rows_now"))) & (F.col("checksum").eqNullSafe(F.col("sum_now")))))
        rows_ok = manifest.where("n_rows > 0").join(now, "file", "full_outer").agg((differs == 0).alias("ok")).first().ok
        keys = [k for k in (files.keys or "").split(",") if k]
        keys_ok = there.select(*keys).distinct().count() == files.n_keys if keys else None
    return spark.createDataFrame([(True, files.files_ok, rows_ok, keys_ok, files.files_expected, files.files_found, files.n_rows)], names)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite one CSV file with a header: for summary tables."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json_summary(df: DataFrame, path: str) -> None:
    """Overwrite one JSON file: for one-row summaries."""
    df.coalesce(1).write.mode("overwrite").json(path)


#: Ids of a sample that are sent to all executors at most; beyond that both sides are shuffled.
BROADCAST_IDS = 100_000
#: Folders of the tables written within each open ``released``, innermost last.
_OPEN: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local folder becomes the session's checkpoint folder in local mode; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if base is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="spark-scratch-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stable(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` computed once: written to the shared folder and read back, which cuts the plan and survives lost executors.

    Within ``released`` the table goes at its end, unless ``keep`` hands it to whatever is around that.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    if len(_OPEN) > keep:
        _OPEN[-1 - keep].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any file system that Spark knows; nothing happens where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Frees the shared folder of the tables that ``stable`` writes within. What outlives it must be written with ``keep``."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete(spark, path)


def parameter_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small dictionary given by the caller as a DataFrame."""
    return spark.createDataFrame(list(rows), schema)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """``n_files, total_bytes, has_success, has_temporary``: Parquet files below ``path``, marks of a finished and of an unfinished write."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = root.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = {n: there.exists(spark._jvm.org.apache.hadoop.fs.Path(root, m)) for n, m in (("has_success", "_SUCCESS"), ("has_temporary", "_temporary"))}
    return files.agg(
        F.count_if(F.col("path").endswith(".parquet")).alias("n_files"),
        F.coalesce(F.sum(F.when(F.col("path").endswith(".parquet"), F.col("length"))), F.lit(0)).alias("total_bytes"),
    ).withColumns({n: F.lit(v) for n, v in marks.items()})


def readback_counts(df: DataFrame, keys: Sequence[str], flag: str | None = None) -> DataFrame:
    """Rows, distinct keys and flagged rows in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.struct(*keys)).alias("n_keys"),
        (F.count_if(F.col(flag) == 1) if flag else F.count(F.lit(1))).alias("n_flagged"),
    )


def hash_order(keys: Sequence[str], seed: str = "") -> list:
    """Columns that put rows in a random order which is the same on each run and engine: the MD5 of the keys' text, then the keys."""
    return [F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in keys))), *keys]


def exact_sample(df: DataFrame, keys: Sequence[str], k: int, by: Sequence[str] = (), seed: str = "") -> DataFrame:
    """Exactly ``k`` rows, or all where there are fewer, of the table or of each group: those with the least hashes of ``keys``.

    The same rows whatever the partitions. Each task keeps ``k`` rows (of each group) and only these are shuffled. Rows
    that are equal in ``keys`` and ``by`` are interchangeable.
    """
    if not by:
        return df.orderBy(*hash_order(keys, seed)).limit(k)
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*hash_order(keys, seed)))
    return df.withColumn("__at", at).where(F.col("__at") <= k).drop("__at")


def exact_entity_sample(df: DataFrame, key: str, k: int, seed: str = "") -> DataFrame:
    """All rows of exactly ``k`` entities, or of all where there are fewer; a null entity is none."""
    ids = exact_sample(df.select(key).where(F.col(key).isNotNull()).distinct(), [key], k, seed=seed)
    return df.join(F.broadcast(ids) if k <= BROADCAST_IDS else ids, key, "left_semi")


def entity_sample(df: DataFrame, key: str, per_thousand: int, seed: int = 1) -> DataFrame:
    """All rows of a stable share of the entities, drawn by a hash of the key: no shuffle, the same on each run."""
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1000)) < per_thousand)
