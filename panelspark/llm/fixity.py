"""Merkle fixity audit of WARC volumes: hash records and ordered ranges into trees, compare, descend where they differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, materialise

VOLUME, FANOUT, LEVELS = 1000, 16, 3
#: Volumes that records without page id are dealt to, by the hash of what they hold.
UNNAMED = 65_536


def warc_records(pages: DataFrame) -> DataFrame:
    """``volume, at, offset, length, page_id, url, record_hash``: each page as a WARC response record, hashed, in its volume's order.

    Volumes hold ``VOLUME`` consecutive page ids; records without id are dealt to ``UNNAMED`` volumes below 0. Null url
    or html is empty. Repeated ids keep the order of their hashes, so equal rows give equal trees. ``offset`` and
    ``length`` are the record's bytes in its volume.
    """
    html, url = (F.coalesce(c, F.lit("")) for c in ("html", "url"))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"))
    record = F.concat(head, F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))
    rows = pages.select("page_id", "url", F.sha2(record, 256).alias("record_hash"), F.octet_length(record).cast("long").alias("length"))
    unnamed = -1 - F.pmod(F.xxhash64("record_hash"), F.lit(UNNAMED))
    rows = rows.withColumn("volume", F.coalesce(F.floor(F.col("page_id") / VOLUME), unnamed).cast("long"))
    by = Window.partitionBy("volume").orderBy("page_id", "record_hash")
    before = F.coalesce(F.sum("length").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"at": (F.row_number().over(by) - 1).cast("long"), "offset": before})


def _above(nodes: DataFrame) -> DataFrame:
    """The next level: each node hashes up to ``FANOUT`` nodes below, in order, and spans their byte range."""
    below = F.array_sort(F.collect_list(F.struct("at", "hash")))
    up = nodes.withColumn("up", F.floor(F.col("at") / FANOUT).cast("long"))
    joined = F.array_join(F.transform(below, lambda x: x["hash"]), "")
    up = up.groupBy("volume", F.col("up").alias("up_")).agg(F.sha2(joined, 256).alias("hash"), F.min("offset").alias("offset"), F.sum("length").alias("length"))
    return up.select("volume", F.col("up_").alias("at"), "offset", "length", "hash")


def tree(records: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Levels of the trees of all volumes, leaves first, each written once; the last has one root for up to ``FANOUT ** levels`` rows."""
    out = [materialise(records.select("volume", "at", "offset", "length", F.col("record_hash").alias("hash"), "page_id"))]
    for _ in range(levels):
        out.append(materialise(_above(out[-1])))
    return out


def audit(primary: DataFrame, replica: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``page_id, volume, at, offset, length, replica_offset, primary_sha256, replica_sha256`` of records that differ between two copies.

    Takes the results of ``warc_records``. The trees' roots are compared, and below only the children of nodes that
    differ; both trees are written once. Byte ranges say where a node lies in either copy; a record that only moved,
    as damage before it grew, does not differ. A record that one side lacks has a null hash there, and those after it
    in its volume, which change places, differ too.
    """
    ours, theirs = tree(primary, levels), tree(replica, levels)
    wrong: DataFrame | None = None
    for level in range(levels, -1, -1):
        a, b = ours[level], theirs[level]
        if wrong is not None:
            a, b = (t.withColumn("up", F.floor(F.col("at") / FANOUT).cast("long")).join(wrong, ["volume", "up"], "left_semi").drop("up") for t in (a, b))
        b = b.select("volume", "at", *(F.col(c).alias(f"r_{c}") for c in b.columns if c not in ("volume", "at")))
        both = a.join(b, ["volume", "at"], "full_outer")
        differ = materialise(both.where(~F.col("hash").eqNullSafe(F.col("r_hash"))))
        wrong = differ.select("volume", F.col("at").alias("up"))
    own = (F.coalesce(c, f"r_{c}").alias(c) for c in ("page_id", "offset", "length"))
    return differ.select("volume", "at", *own, F.col("r_offset").alias("replica_offset"), F.col("hash").alias("primary_sha256"), F.col("r_hash").alias("replica_sha256"))


def damaged(html: Column, page_id: Column) -> Column:
    """The replica's page: one added byte in every 97th page, from the sixth on."""
    return F.when(page_id % 97 == 5, F.concat(html, F.lit("#"))).otherwise(html)


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locate the damaged records of a replica of all pages, with their byte ranges.

    Null html stays undamaged; records without ``page_id`` are audited like others; repeated rows are records each.
    """
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    replica = pages.withColumn("html", damaged(F.col("html"), F.col("page_id")))
    found = audit(warc_records(pages), warc_records(replica))
    return found.select("page_id", "volume", "at", "offset", "length", "replica_offset", "primary_sha256", "replica_sha256")


ORACLE_SQL = """
WITH r AS (
  SELECT page_id, CAST(floor(page_id / 1000.0) AS BIGINT) AS volume, url, html,
         CASE WHEN page_id % 97 = 5 THEN html || '#' ELSE html END AS other
  FROM pages
), h AS (
  SELECT page_id, volume,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
      || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
      || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS a,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
      || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(other, '')) || chr(13) || chr(10) || chr(13) || chr(10)
      || coalesce(other, '') || chr(13) || chr(10) || chr(13) || chr(10) AS b
  FROM r
), o AS (
  SELECT page_id, volume, sha256(a) AS primary_sha256, sha256(b) AS replica_sha256, strlen(a) AS n,
    row_number() OVER w - 1 AS "at", sum(strlen(a)) OVER w - strlen(a) AS s, sum(strlen(b)) OVER w - strlen(b) AS t
  FROM h WINDOW w AS (PARTITION BY volume ORDER BY page_id)
)
SELECT page_id, volume, CAST("at" AS BIGINT) AS "at", CAST(s AS BIGINT) AS "offset", CAST(n AS BIGINT) AS length, CAST(t AS BIGINT) AS replica_offset, primary_sha256, replica_sha256
FROM o WHERE primary_sha256 <> replica_sha256
"""
