"""Suffix-array dedup: common-prefix intervals of an enhanced suffix array, over the places where texts can repeat."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialise, partitions, release, scratch, slices, small_batches

#: Bytes of an anchor; bytes and rows of texts that make one blob; contexts of one anchor in one suffix array; places hashed at once.
GRAM, BATCH_BYTES, BATCH_ROWS, LARGE, STEP = 20, 4_000_000, 50_000, 20_000, 1 << 16
#: Bytes that one task exchanges or one bucket of blobs holds; Spark writes no more buckets than ``MOST_BUCKETS``, beyond it they grow.
EXCHANGE, BUCKET, MOST_BUCKETS = 64_000_000, 128_000_000, 100_000
_MIX = np.uint64(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(99).integers(0, 2**64, 256, dtype=np.uint64)


def _rolled(b: np.ndarray) -> np.ndarray:
    """Hash of each run of ``GRAM`` bytes: doubling, 1 to 16 and 4 more."""
    at, kept = _TABLE[b], {}
    for n in (1, 2, 4, 8):
        kept[n] = at
        at = at[:-n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n) + (at[n:] ^ (at[n:] >> np.uint64(31)))
    at = at[:-4] * np.uint64(0xC2B2AE3D27D4EB4F) + kept[4][16:]
    at = (at ^ (at >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return at ^ (at >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    pick, n = (np.minimum if least else np.maximum), 1
    while 2 * n <= width:
        x = pick(x[:-n], x[n:])
        n *= 2
    return pick(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def anchors(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the least gram of each window of ``length`` bytes: equal windows have equal anchors.

    Works on ``STEP`` places at a time with the neighbours that their windows reach, so that arrays stay in the cache.
    """
    width, n = length - GRAM + 1, len(b) - GRAM + 1
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    pad = np.zeros(width - 1, np.uint64)
    for s in range(0, n if len(b) >= length else 0, STEP):
        first, last = max(0, s - width + 1), min(n, s + STEP + width - 1)
        h = _rolled(b[first : last + GRAM - 1])
        highest = _sliding(np.concatenate([pad, _sliding(h, width, True), pad]), width, False)
        at = np.nonzero(highest == h)[0]
        at = at[(at + first >= s) & (at + first < s + STEP)]
        places.append(at + first)
        hashes.append(h[at])
    return np.concatenate(places), np.concatenate(hashes)


_CHUNK = {"batch": pa.int64(), "ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "hashes": pa.list_(pa.binary()), "blob": pa.binary(), "rest": pa.binary()}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed blobs of about ``BATCH_BYTES``, one row each; columns after id and text go along as they are."""
    packer, task, made = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32, 0

    def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        raw = [x or b"" for x in t.column(1).cast(pa.binary()).to_pylist()]
        rest = None
        if t.num_columns > 2:
            kept = t.select(range(2, t.num_columns)).append_column("__null", t.column(1).is_null())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept.schema) as w:
                w.write_table(kept)
            rest = packer.compress(sink.getvalue())
        columns = [[task + made], [t.column(0).to_pylist()], [[len(r) for r in raw]], [[xxhash.xxh128_digest(r) for r in raw]], [packer.compress(b"".join(raw))], [rest]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _CHUNK.values(), strict=True)], list(_CHUNK))

    parts: list[pa.RecordBatch] = []
    for part in slices(batches, 1, BATCH_BYTES):
        parts.append(part)
        if sum(p.nbytes for p in parts) >= BATCH_BYTES or sum(p.num_rows for p in parts) >= BATCH_ROWS:
            yield row(parts)
            parts, made = [], made + 1
    if parts:
        yield row(parts)


def chunks(docs: DataFrame, rest: list[str], total: int) -> DataFrame:
    """The documents packed into blobs, in a table bucketed by ``batch``: later passes over the blobs shuffle no texts."""
    spark = docs.sparkSession
    small_batches(spark)
    n = min(MOST_BUCKETS, max(partitions(spark), -(-total // BUCKET)))
    columns = [F.col(c) for c in rest]
    packed = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text"), *columns)
    packed = packed.mapInArrow(_pack, "batch long, ids array<long>, sizes array<int>, hashes array<binary>, blob binary, rest binary")
    name = f"blobs_{uuid.uuid4().hex}"
    packed.repartition(n, "batch").write.bucketBy(n, "batch").option("path", f"{scratch(spark)}/tables/{name}").saveAsTable(name)
    return spark.table(name)


class _Texts:
    """One blob, open: its bytes, where each text begins and the last ends, and the anchors of the texts not ``left_out``."""

    def __init__(self, t: pa.Table, length: int):
        self.ids = np.array(t.column("ids")[0].as_py(), np.int64)
        self.starts = np.concatenate([[0], np.cumsum(t.column("sizes")[0].as_py())]).astype(np.int64)
        data = zstandard.ZstdDecompressor().decompress(t.column("blob")[0].as_py(), max_output_size=max(1, int(self.starts[-1])))
        self.data = np.frombuffer(data, np.uint8)
        self.batch, self.length, self._rest = t.column("batch")[0].as_py(), length, t.column("rest")[0]

    def anchors(self, left_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, h = anchors(self.data, self.length)
        row = self.row(at)
        kept = np.ones(len(self.ids), bool)
        kept[left_out] = False
        inside = (at + GRAM <= self.starts[row + 1]) & kept[row]
        return at[inside], h[inside]

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the context of an anchor begins and ends: all windows that hold it, within its text."""
        row = self.row(at)
        return np.maximum(self.starts[row], at - (self.length - GRAM)), np.minimum(self.starts[row + 1], at + self.length)

    def contexts(self, at: np.ndarray) -> np.ndarray:
        """The contexts' bytes, one a row, from ``length - GRAM`` bytes before the anchor on; zeros beyond the text."""
        wide = 2 * self.length - GRAM
        begin, end = self.around(at)
        first = at - (self.length - GRAM)
        data = self.data if len(self.data) >= wide else np.concatenate([self.data, np.zeros(wide, np.uint8)])
        out = np.lib.stride_tricks.sliding_window_view(data, wide)[np.clip(first, 0, len(data) - wide)]
        cut = np.nonzero((begin != first) | (end != first + wide))[0]
        if len(cut):
            out = out.copy()
            place = first[cut, None] + np.arange(wide)
            inside = (place >= begin[cut, None]) & (place < end[cut, None])
            out[cut] = np.where(inside, data[np.clip(place, 0, len(data) - 1)], 0)
        return out

    def rest(self) -> pa.Table:
        return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompressobj().decompress(self._rest.as_py())).read_all()


def _names(contexts: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """64-bit hashes of contexts and of where their anchor is in them."""
    wide = contexts.shape[1]
    words = np.zeros((len(contexts), -(-wide // 8) * 8), np.uint8)
    words[:, :wide] = contexts
    h = (before.astype(np.uint64) << np.uint64(8) | after.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    for w in words.view(np.uint64).T:
        h = (h ^ w) * _MIX
        h ^= h >> np.uint64(29)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)


def _by_bucket(records: np.ndarray, bucket: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The records of each bucket, as bytes."""
    if not len(records):
        return [], []
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    cuts = np.nonzero(np.diff(bucket))[0] + 1
    return bucket[np.concatenate([[0], cuts])].tolist(), [v.tobytes() for v in np.split(records, cuts)]


def _together(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """All records of a packed column, and the row that each came from."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column] or [np.zeros(0, kind)]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def intervals(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common-prefix intervals of a suffix array: depth, first and last suffix of each, by one scan with a stack.

    ``common[k]`` is the length that suffixes ``k`` and ``k + 1`` share, negative between different anchors.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[list[int]] = []
    for k, c in enumerate([*common.tolist(), -1]):
        first = k
        while stack and stack[-1][0] > c:
            depth, first = stack.pop()
            out.append((depth, first, k))
        if c >= 0 and (not stack or stack[-1][0] < c):
            stack.append([c, first])
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def _reach(group: np.ndarray, side: np.ndarray, size: np.ndarray, other: np.ndarray, room: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    """How far each context's greatest repeat with a smaller ``low`` reaches to one side of the anchor; -1 without one.

    ``side`` has the bytes from the anchor on towards this side, ``size`` how many there are. The suffixes that start
    at the anchors are sorted and their common-prefix intervals found; the members of an interval are told apart by
    their extension to the other side, as far as makes ``length`` bytes with the interval's depth. Members that agree
    there repeat each other; all of them but the least get the depth, the deepest first.
    """
    wide = -(-side.shape[1] // 8) * 8
    padded = np.zeros((len(side), wide), np.uint8)
    padded[:, : side.shape[1]] = side
    order = np.lexsort((*padded.view(">u8").astype(np.uint64).T[::-1], group))
    x = side[order]
    differ = x[1:] != x[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), side.shape[1])
    common = np.minimum(common, np.minimum(size[order][1:], size[order][:-1]))
    common[group[order][1:] != group[order][:-1]] = -1
    depth, first, last = intervals(common)
    hashes = np.empty((len(other), other.shape[1] + 1), np.uint64)
    hashes[:, 0] = h = np.full(len(other), 7, np.uint64)
    for k in range(other.shape[1]):
        h = (h ^ (other[:, k] + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(31)
        hashes[:, k + 1] = h
    out = np.full(len(side), -1)
    for d in np.unique(depth)[::-1].tolist():
        need = length - d
        if need > other.shape[1]:
            break
        own = np.nonzero(depth == d)[0]
        n = last[own] - first[own] + 1
        which = np.repeat(own, n)
        member = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[which]]
        open_ = room[member] >= need
        which, member = which[open_], member[open_]
        key = hashes[member, need] ^ (which.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        by = np.argsort(key)
        key, member = key[by], member[by]
        if len(key):
            heads = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1])
            least = np.repeat(np.minimum.reduceat(low[member], heads), np.diff([*heads, len(key)]))
            hit = member[low[member] > least]
            out[hit[out[hit] < 0]] = d
    return out


#: Fixed layouts of packed rows: anchors in their contexts as a blob names them, and contexts with their bytes.
_ENTRY = np.dtype([("name", "<u8"), ("anchor", "<u8"), ("low", "<i8"), ("entry", "<i4")])


def _context(length: int) -> np.dtype:
    return np.dtype([("group", "<u8"), ("low", "<i8"), ("entry", "<i4"), ("large", "<i4"), ("before", "<i4"), ("after", "<i4"), ("bytes", "u1", 2 * length - GRAM)])


def repeated_spans(packed: DataFrame, length: int, total: int) -> DataFrame:
    """What each blob has to know of the others: rows ``b, kind, row, s, e, data`` for ``_covered``.

    A byte is covered by a ``length``-byte string that also starts in a document of a smaller ``doc_id``. Of equal
    texts only the first takes part; the others go whole. Each window of ``length`` bytes has an anchor, so only
    anchors that two documents share are looked at: blobs send 32 bits of their distinct anchor hashes, get back those
    that repeat, and name the contexts around them by hash, each once a blob. Where an anchor has several contexts, the
    bytes of each are fetched once, and the suffixes that start at its anchors make one suffix array to the right and
    one to the left. Contexts of an anchor with over ``LARGE`` of them are dealt to several arrays; their windows are
    then also matched by value across the arrays, which pre-aggregates, so no task holds them all.
    """
    n_buckets = max(partitions(packed.sparkSession), -(-total // (2 * EXCHANGE)))
    wide, left = 2 * length - GRAM, length - GRAM

    texts = packed.select("batch", F.posexplode(F.arrays_zip("ids", "sizes", "hashes")).alias("row", "t")).select("batch", "row", "t.*")
    texts = texts.where(F.col("sizes") >= length)
    first = texts.groupBy("hashes").agg(F.min("ids").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = materialise(texts.join(first.drop("n"), "hashes").where("ids > least").select(F.col("batch").alias("b"), "row"))

    def send(t: pa.Table, left_out: pa.Table) -> pa.Table:
        bucket, found, batch = [], [], 0
        if t.num_rows:
            own = _Texts(t, length)
            at, h = own.anchors(left_out.column("row").to_numpy())
            ids, batch = own.ids[own.row(at)], own.batch
            order = np.argsort(h)
            h, ids = h[order], ids[order]
            again = (h[1:] == h[:-1]) & (ids[1:] != ids[:-1])
            one = h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h
            sent = np.concatenate([one, np.unique(h[1:][again])])  # twice if two documents here have it
            bucket, found = _by_bucket(sent.astype(np.uint32), (sent >> np.uint64(32)) % np.uint64(n_buckets))
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "b": pa.array([batch] * len(found), pa.int64()), "data": pa.array(found, pa.binary())})

    def shared(t: pa.Table) -> pa.Table:
        h, of = _together(t.column("data"), np.uint32)
        order = np.argsort(h)
        same = np.nonzero(h[order][1:] == h[order][:-1])[0]
        keep = np.zeros(len(h), bool)
        keep[order[same]] = keep[order[same + 1]] = True
        row, found = _by_bucket(h[keep], of[keep])
        at = pa.array(row, pa.int64())
        return pa.table({"bucket": t.column("bucket").take(at), "b": t.column("b").take(at), "data": pa.array(found, pa.binary())})

    def name(t: pa.Table, back: pa.Table) -> pa.Table:
        kind, bucket, data, batch = [], [], [], 0
        if t.num_rows:
            own, batch = _Texts(t, length), t.column("batch")[0].as_py()
            row = back.column("row")
            at, h = own.anchors(row.drop_null().to_numpy())
            hits = [np.zeros(0, np.uint64)]
            for k, x in zip(back.column("bucket").to_pylist(), back.column("data"), strict=True):
                if k is not None:
                    hits.append(np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64) | np.uint64(k << 32))
            begin, end = own.around(at)
            hit = np.isin((h >> np.uint64(32)) % np.uint64(n_buckets) << np.uint64(32) | h & np.uint64(0xFFFFFFFF), np.concatenate(hits)) & (end - begin >= length)
            at, h, begin, end = at[hit], h[hit], begin[hit], end[hit]
            names = np.zeros(len(at), np.uint64)
            for s in range(0, len(at), STEP):
                part = at[s : s + STEP]
                names[s : s + STEP] = _names(own.contexts(part), part - begin[s : s + STEP], end[s : s + STEP] - part)
            if len(at):
                order = np.argsort(names)
                heads = np.concatenate([[0], np.nonzero(np.diff(names[order]))[0] + 1])
                entry = np.empty(len(at), np.int32)
                entry[order] = np.repeat(np.arange(len(heads)), np.diff([*heads, len(at)]))
                e = np.zeros(len(heads), _ENTRY)
                e["name"], e["anchor"], e["entry"] = names[order][heads], h[order][heads], np.arange(len(heads))
                e["low"] = np.minimum.reduceat(own.ids[own.row(at)][order], heads)
                bucket, data = _by_bucket(e, e["name"] % np.uint64(n_buckets))
                kind = [1] * len(data) + [0]
                bucket, data = [*bucket, None], [*data, np.concatenate([at.astype(np.int32), entry]).tobytes()]
        return pa.table({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int64()), "b": pa.array([batch] * len(kind), pa.int64()), "data": pa.array(data, pa.binary())})

    def decide(t: pa.Table) -> pa.Table:
        """Which entries of a blob have an equal context in a smaller document, and the least entry of each context."""
        e, of = _together(t.column("data"), _ENTRY)
        order = np.argsort(e["name"])
        e, of = e[order], of[order]
        heads = np.concatenate([[0], np.nonzero(np.diff(e["name"]))[0] + 1])
        least = np.repeat(np.minimum.reduceat(e["low"], heads), np.diff([*heads, len(e)]))
        whole = e["low"] > least
        b = t.column("b").to_numpy()
        rows, data = _by_bucket(e["entry"][whole], of[whole])
        one, k = e[~whole], len(rows)
        n = k + len(one)
        return pa.table(
            {
                "b": np.concatenate([b[rows], b[of[~whole]]]).astype(np.int64), "entry": np.concatenate([np.full(k, -1), one["entry"]]).astype(np.int32),
                "anchor": np.concatenate([np.zeros(k, np.uint64), one["anchor"]]).view(np.int64), "low": np.concatenate([np.zeros(k, np.int64), one["low"]]),
                "data": pa.array(data + [None] * (n - k), pa.binary()),
            }
        )

    def fetch(t: pa.Table, asked: pa.Table) -> pa.Table:
        some, data, batch = [], [], 0
        place = [x for x in asked.column("data") if x.is_valid]
        if t.num_rows and place:
            own, batch = _Texts(t, length), t.column("batch")[0].as_py()
            at, entry = np.frombuffer(place[0].as_buffer(), np.int32).reshape(2, -1).astype(np.int64)
            where = np.zeros(entry.max() + 1, np.int64)
            where[entry] = at
            wanted = asked.filter(asked.column("data").is_null())
            which, n = wanted.column("entry").to_numpy(), wanted.column("n").to_numpy()
            at = where[which]
            begin, end = own.around(at)
            c = np.zeros(len(at), _context(length))
            parts = np.uint64(batch) * np.uint64(0x9E3779B9) + which.astype(np.uint64) * _MIX >> np.uint64(33)
            parts %= (-(-n // LARGE)).astype(np.uint64)
            c["group"] = wanted.column("anchor").to_numpy().view(np.uint64) ^ parts * np.uint64(0x165667B19E3779F9)
            c["low"], c["entry"], c["large"], c["before"], c["after"] = wanted.column("low").to_numpy(), which, n > LARGE, at - begin, end - at
            for s in range(0, len(at), STEP):
                c["bytes"][s : s + STEP] = own.contexts(at[s : s + STEP])
            some, data = _by_bucket(c, (c["group"] ^ c["group"] >> np.uint64(32)) % np.uint64(n_buckets))
        return pa.table({"some": pa.array(some, pa.int64()), "b": pa.array([batch] * len(some), pa.int64()), "data": pa.array(data, pa.binary())})

    def scan(t: pa.Table) -> pa.Table:
        c, of = _together(t.column("data"), _context(length))
        after = np.where(np.arange(length) < c["after"][:, None], c["bytes"][:, left:], 0)
        before = np.where(np.arange(left) < c["before"][:, None], c["bytes"][:, :left][:, ::-1], 0)
        right = _reach(c["group"], after, c["after"], before, c["before"], c["low"], length)
        back = _reach(c["group"], before, c["before"], after, c["after"], c["low"], length)
        b, hit = t.column("b").to_numpy()[of], np.nonzero(right >= 0)[0]
        out = {
            "b": [b[hit]], "entry": [c["entry"][hit]], "s": [-back[hit]], "e": [right[hit]],
            "low": [np.zeros(len(hit), np.int64)], "window": [None] * len(hit),
        }
        release()
        large = np.nonzero(c["large"])[0]
        for s in range(left + 1 if len(large) else 0):
            own = large[(c["before"][large] >= s) & (c["after"][large] >= length - s)]
            for k, v in (("b", b[own]), ("entry", c["entry"][own]), ("s", np.full(len(own), -s)), ("e", np.full(len(own), length - s)), ("low", c["low"][own])):
                out[k].append(v)
            out["window"] += [x.tobytes() for x in c["bytes"][own, left - s : left - s + length]]
        kinds = {"b": pa.int64(), "entry": pa.int32(), "s": pa.int32(), "e": pa.int32(), "low": pa.int64()}
        return pa.table({k: pa.array(np.concatenate(out[k]), v) for k, v in kinds.items()} | {"window": pa.array(out["window"], pa.binary())})

    by_batch = packed.select("batch", "ids", "sizes", "blob", F.lit(None).cast("binary").alias("rest")).groupBy("batch")
    sent = by_batch.cogroup(copies.groupBy("b")).applyInArrow(send, "bucket long, b long, data binary")
    back = sent.groupBy("bucket").applyInArrow(shared, "bucket long, b long, data binary").withColumn("row", F.lit(None).cast("int"))
    back = back.unionByName(copies, allowMissingColumns=True)
    named = materialise(by_batch.cogroup(back.groupBy("b")).applyInArrow(name, "kind int, bucket long, b long, data binary"))
    places = named.where("kind = 0").select("b", "data")
    decided = materialise(named.where("kind = 1").groupBy("bucket").applyInArrow(decide, "b long, entry int, anchor long, low long, data binary"))
    one = decided.where("data is null").drop("data")
    several = one.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("least"), F.max("low").alias("most")).where("n > 1 and least < most")
    asked = one.join(several.select("anchor", F.col("n").cast("long")), "anchor").unionByName(places, allowMissingColumns=True)
    fetched = by_batch.cogroup(asked.groupBy("b")).applyInArrow(fetch, "some long, b long, data binary")
    scanned = materialise(fetched.groupBy("some").applyInArrow(scan, "b long, entry int, s int, e int, low long, window binary"))
    windows = scanned.where("window is not null")
    least = windows.groupBy(F.col("window").alias("w")).agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    crossed = windows.join(least, (windows.window == least.w) & (windows.low > least.least))
    spans = scanned.where("window is null").unionByName(crossed, allowMissingColumns=True).select("b", F.lit(2).alias("kind"), F.col("entry").alias("row"), "s", "e")
    out = spans.unionByName(places.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    out = out.unionByName(decided.where("data is not null").select("b", F.lit(1).alias("kind"), "data"), allowMissingColumns=True)
    return out.unionByName(copies.withColumn("kind", F.lit(3)), allowMissingColumns=True)


def _covered(own: _Texts, known: pa.Table) -> np.ndarray:
    """For each byte of a blob, whether it goes."""
    kind, row = known.column("kind").to_numpy(), known.column("row").fill_null(0).to_numpy()
    delta = np.zeros(len(own.data) + 1, np.int32)

    def cover(begin: np.ndarray, end: np.ndarray) -> None:
        np.add.at(delta, begin, 1)
        np.add.at(delta, end, -1)

    copies = row[kind == 3]
    cover(own.starts[copies], own.starts[copies + 1])
    for i in np.nonzero(kind == 0)[0].tolist():
        at, entry = np.frombuffer(known.column("data")[i].as_buffer(), np.int32).reshape(2, -1).astype(np.int64)
        ids, (begin, end) = own.ids[own.row(at)], own.around(at)
        low = np.full(entry.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, entry, ids)
        elsewhere = np.zeros(len(low), bool)
        for j in np.nonzero(kind == 1)[0].tolist():
            elsewhere[np.frombuffer(known.column("data")[j].as_buffer(), np.int32)] = True
        whole = elsewhere[entry] | (ids > low[entry])
        cover(begin[whole], end[whole])
        order = np.argsort(entry, kind="stable")
        span = np.nonzero(kind == 2)[0]
        lo, hi = (np.searchsorted(entry[order], row[span], side=x) for x in ("left", "right"))
        n = hi - lo
        span = np.repeat(span, n)
        place = at[order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]]
        s, e = (known.column(c).fill_null(0).to_numpy()[span] for c in ("s", "e"))
        cover(place + s, place + e)
    return np.cumsum(delta[:-1]) > 0


def _by_document(docs: DataFrame, length: int, rest: list[str], finish: Callable[[_Texts, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """Apply ``finish(blob, covered bytes)`` to all documents that have an id, a blob at a time."""
    docs = docs.where("doc_id is not null")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packed = chunks(docs, rest, total)
    known = repeated_spans(packed, length, total)

    def run(t: pa.Table, known: pa.Table) -> pa.Table:
        own = _Texts(t, length)
        return finish(own, _covered(own, known))

    return packed.groupBy("batch").cogroup(known.groupBy("b")).applyInArrow(run, schema)


def _kept(own: _Texts, covered: np.ndarray) -> list[bytes]:
    """What stays of each text."""
    raw = own.data[~covered].tobytes()
    ends = np.concatenate([[0], np.cumsum(~covered)])[own.starts].tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with each text less the bytes that repeat an earlier document's; ``n_chars`` follows, other columns stay.

    Cut characters go whole. A null text stays null; a text that repeats in full becomes empty. Rows of one ``doc_id``
    count as one document; a row without ``doc_id`` stays as it is and others are not held against it. Of equal texts
    under one ``doc_id`` each stays or goes like the other.
    """
    rest = [c for c in docs.columns if c != "text"]
    names = docs.columns

    def finish(own: _Texts, covered: np.ndarray) -> pa.Table:
        kept = own.rest()
        text = pa.array([None if n else x.decode("utf-8", "ignore") for x, n in zip(_kept(own, covered), kept.column("__null").to_pylist(), strict=True)], pa.string())
        return pa.table({c: text if c == "text" else kept.column(c) for c in names})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = _by_document(docs, length, rest, finish, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.unionByName(docs.where("doc_id is null"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats an earlier document in runs of 50 bytes, for all documents.

    Null text counts as empty. Rows of one ``doc_id`` count as one document and are returned one by one; rows without
    ``doc_id`` keep all and nothing is held against them. An empty table gives an empty result.
    """

    def finish(own: _Texts, covered: np.ndarray) -> pa.Table:
        gone = np.concatenate([[0], np.cumsum(covered)])
        begins = covered & np.concatenate([[True], ~covered[:-1]]) if len(covered) else covered
        starts = own.starts[:-1][np.diff(own.starts) > 0]
        begins[starts] = covered[starts]
        runs = np.concatenate([[0], np.cumsum(begins)])
        digests = [hashlib.sha256(x).hexdigest() for x in _kept(own, covered)]
        columns = (own.ids, np.diff(own.starts), np.diff(gone[own.starts]), np.diff(runs[own.starts]))
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("doc_id", "n_bytes", "n_removed", "n_spans"), columns, strict=True)} | {"kept_sha256": digests})

    docs = load(spark, sf_dir, "documents")
    out = _by_document(docs, 50, [], finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rest = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.octet_length(raw).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.sha2(raw, 256))
    return out.union(rest)
