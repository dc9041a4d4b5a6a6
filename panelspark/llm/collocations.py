"""Phrase collocation mining by SON partitioning: shards mined completely at lowered support, candidates counted exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucketed, load, materialise, partitions, release, released, slices, small_batches

#: Shards of the corpus, each spread over many tasks. A phrase with the global support has a ``SHARDS``-th of it in one of them.
SHARDS = 4
SUPPORT, LONGEST, TOP, COVER = 30, 4, 2000, 80
#: Bytes of texts in one block; bytes of texts to each bucket of phrases and of blocks; Spark writes no more buckets of blocks than ``MOST_BUCKETS``.
BLOCK, BUCKET, MOST_BUCKETS = 4_000_000, 16_000_000, 100_000
NO_LANG = "und"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
#: What each byte does: 0 belongs to a word, 1 parts words, 2 parts pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def words_of(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The words of all texts one after another, the row of each, and whether the next word continues its piece.

    A-Z is lower-cased. Nulls and texts without words have none.
    """
    texts = pc.ascii_lower(texts.cast(pa.large_string()).fill_null(""))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first = int(offsets[0])
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[first : int(offsets[-1])]
    offsets = offsets - first
    kind = _KIND[data]
    inside = kind == 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]  # where texts begin
    begin[heads] = inside[heads]
    starts = np.nonzero(begin)[0]
    row = np.searchsorted(offsets, starts, side="right") - 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int64)
    same = np.zeros(len(starts), bool)
    same[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
    kept = np.concatenate([np.zeros(1, np.int32), np.cumsum(inside, dtype=np.int32)])
    bounds = np.concatenate([kept[starts], kept[-1:]]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[inside]))
    return words, row, same


_BLOCK = "block long, shard int, langs array<string>, words binary, body binary"


def _pack(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Texts as blocks of word codes: the distinct words, and for each place its word, language and whether its piece goes on."""
    packer, task, made = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
    for batch in slices(batches, 1, BLOCK):
        words, row, same = words_of(batch.column(1))
        if not len(words):
            continue
        known = words.dictionary_encode()
        langs = batch.column(0).fill_null(NO_LANG).dictionary_encode()
        code = known.indices.to_numpy().astype("<i4")
        lang = langs.indices.to_numpy()[row].astype("<i4")
        body = packer.compress(code.tobytes() + lang.tobytes() + same.astype(np.uint8).tobytes())
        lexicon = packer.compress("\n".join(known.dictionary.to_pylist()).encode())
        columns = [[(task << 32) + made], [(task + made) % shards], [langs.dictionary.to_pylist()], [lexicon], [body]]
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.binary(), pa.binary())
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "shard", "langs", "words", "body"])
        del words, row, same, known, code, lang, body, lexicon, columns
        release()
        yield out
        made += 1


class _Block:
    """One block, open: ``code``, ``lang`` and ``same`` of each place, the words and the languages."""

    def __init__(self, t: pa.Table):
        opener = zstandard.ZstdDecompressor()
        self.block, self.shard, self.langs = (t.column(c)[0].as_py() for c in ("block", "shard", "langs"))
        self.words = opener.decompress(t.column("words")[0].as_py()).decode().split("\n")
        body = opener.decompress(t.column("body")[0].as_py())
        n = len(body) // 9
        self.code, self.lang = (np.frombuffer(body, "<i4", n, 4 * n * k).astype(np.int64) for k in (0, 1))
        self.same = np.frombuffer(body, np.uint8, n, 8 * n).astype(bool)

    def places(self, length: int) -> np.ndarray:
        """Where a phrase of so many words begins within a piece."""
        ok = np.ones(max(0, len(self.code) - length + 1), bool)
        for k in range(length - 1):
            ok &= self.same[k : k + len(ok)]
        return ok

    def hashes(self, length: int) -> np.ndarray:
        """A hash of the language and words of the phrase at each place, with no regard to pieces."""
        own = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words), np.uint64, len(self.words))[self.code]
        h = np.fromiter((xxhash.xxh64_intdigest(x, 7) for x in self.langs), np.uint64, len(self.langs))[self.lang]
        h = h[: max(0, len(own) - length + 1)]
        for k in range(length):
            h = (h ^ own[k : k + len(h)]) * _MIX[k]
            h = h ^ (h >> np.uint64(29))
        return (h + np.uint64(length)) * _MIX[3] ^ (h >> np.uint64(31))


def _keys(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket and 32 bits of each hash in one integer."""
    return ((h >> np.uint64(32)) % np.uint64(n_buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _sent(block: _Block, keys: np.ndarray) -> pa.Table:
    """The distinct keys of a block with their counts, one row a bucket."""
    one, n = np.unique(keys, return_counts=True)
    bucket = (one >> np.uint64(32)).astype(np.int64)
    cuts = np.nonzero(np.diff(bucket))[0] + 1
    rows = [bucket[np.concatenate([[0], cuts])].tolist()] if len(one) else [[]]
    rows += [[block.block] * len(rows[0]), [block.shard] * len(rows[0])]
    rows += [[x.tobytes() for x in np.split(v.astype("<u4"), cuts)] if len(one) else [] for v in (one, n)]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["bucket", "block", "shard", "hashes", "counts"])


_SENT, _BACK = "bucket long, block long, shard int, hashes binary, counts binary", "block long, bucket long, hashes binary"


def mined(t: pa.Table, support: int) -> pa.Table:
    """One bucket's share of all shards: each mined by itself at ``support``, the frequent keys united, and of each block those it has."""
    shard = t.column("shard").to_numpy()
    parts, counts = ([np.frombuffer(x.as_buffer(), "<u4") for x in t.column(c)] for c in ("hashes", "counts"))
    frequent = [np.zeros(0, np.uint32)]
    for s in np.unique(shard):
        own = np.nonzero(shard == s)[0]
        h, n = (np.concatenate([x[i] for i in own]) for x in (parts, counts))
        one, at = np.unique(h, return_inverse=True)
        frequent.append(one[np.bincount(at, n) >= support])
    union = np.unique(np.concatenate(frequent))
    kept = [p[np.isin(p, union, assume_unique=True)].tobytes() for p in parts]
    some = pa.array([i for i, k in enumerate(kept) if k], pa.int64())
    release()
    return pa.table({"block": t.column("block").take(some), "bucket": t.column("bucket").take(some), "hashes": pa.array([k for k in kept if k], pa.binary())})


def _returned(back: pa.Table) -> np.ndarray:
    """Sorted keys of the candidates that a block was told of."""
    parts = [np.frombuffer(x.as_buffer(), "<u4").astype(np.uint64) | np.uint64(k << 32) for k, x in zip(back.column("bucket").to_pylist(), back.column("hashes"), strict=True)]
    return np.sort(np.concatenate([*parts, np.zeros(0, np.uint64)]))


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _flags(block: _Block, known: np.ndarray, n_buckets: int, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Whether a candidate of each length begins at each place."""
    out = {}
    for n in lengths:
        out[n] = block.places(n)
        at = np.nonzero(out[n])[0]
        out[n][at] = _among(_keys(block.hashes(n)[at], n_buckets), known)
    return out


def _extended(pairs: np.ndarray, length: int) -> np.ndarray:
    """Places from which all neighbouring pairs of a phrase of this length are candidates."""
    ok = np.ones(max(0, len(pairs) - length + 2), bool)
    for k in range(length - 1):
        ok &= pairs[k : k + len(ok)]
    return ok


def _counted(block: _Block, flags: dict[int, np.ndarray]) -> pa.Table:
    """Exact counts of a block's candidates by language and words, and of all its words by language."""
    total = np.bincount(block.lang, minlength=len(block.langs))
    langs, phrases, lengths, counts = list(block.langs), [None] * len(block.langs), [0] * len(block.langs), total.tolist()
    size = len(block.words)
    name = block.lang * size + block.code
    for n in range(1, LONGEST + 1):
        if n > 1:  # numbers of distinct phrases stay below the number of places, so the product fits 64 bits
            _, name = np.unique(name[: max(0, len(block.code) - n + 1)], return_inverse=True)
            name = name.astype(np.int64) * size + block.code[n - 1 :][: len(name)]
        at = np.nonzero(flags[n])[0]
        _, first, count = np.unique(name[at], return_index=True, return_counts=True)
        first = at[first]
        langs += [block.langs[k] for k in block.lang[first].tolist()]
        phrases += [" ".join([block.words[c] for c in own]) for own in np.stack([block.code[first + k] for k in range(n)], 1).tolist()]
        lengths += [n] * len(first)
        counts += count.tolist()
    return pa.table({"lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.string()), "length": pa.array(lengths, pa.int32()), "f": pa.array(counts, pa.int64())})


def phrase_counts(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS) -> DataFrame:
    """``lang, phrase, length, f``: exact counts of all phrases of 1 to 4 words with ``f >= support``; a null phrase has a language's words.

    The corpus is dealt to ``shards`` shards. A phrase that occurs ``support`` times occurs at least ``support / shards``
    times, rounded up, in one of them. Each shard is mined completely at that count, words and pairs first, then longer
    phrases all of whose pairs were found; blocks send hashes with counts to buckets of one shard and hash range each.
    Colliding hashes can only add candidates. What is frequent in any shard is a candidate, and all its occurrences in
    all blocks are then counted by the words themselves. Texts go as blocks of about ``BLOCK`` bytes; nothing is broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(partitions(spark), -(-total // BUCKET))
    local = -(-support // shards)
    blocks = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(lambda b: _pack(b, shards), _BLOCK)
    blocks = bucketed(blocks, min(MOST_BUCKETS, n_buckets), "block")
    by_block = blocks.groupBy("block")

    def short(t: pa.Table) -> pa.Table:
        own = _Block(t)
        keys = [_keys(own.hashes(n)[own.places(n)], n_buckets) for n in (1, 2)]
        return _sent(own, np.concatenate(keys))

    def longer(t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())], names=["bucket", "block", "shard", "hashes", "counts"])
        own = _Block(t)
        pairs = _flags(own, _returned(back), n_buckets, (2,))[2]
        keys = [_keys(own.hashes(n)[_extended(pairs, n)], n_buckets) for n in range(3, LONGEST + 1)]
        return _sent(own, np.concatenate(keys))

    def count(t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "length": pa.array([], pa.int32()), "f": pa.array([], pa.int64())})
        own = _Block(t)
        out = _counted(own, _flags(own, _returned(back), n_buckets, tuple(range(1, LONGEST + 1))))
        release()
        return out

    mine = lambda sent: materialise(sent.groupBy("bucket").applyInArrow(lambda t: mined(t, local), _BACK))
    found = mine(by_block.applyInArrow(short, _SENT))
    found2 = mine(by_block.cogroup(found.groupBy("block")).applyInArrow(longer, _SENT))
    all_found = found.unionByName(found2)
    counts = by_block.cogroup(all_found.groupBy("block")).applyInArrow(count, "lang string, phrase string, length int, f long")
    return counts.groupBy("lang", "phrase", "length").agg(F.sum("f").alias("f")).where(f"phrase is null or f >= {support}")


def _parts(phrase: str, first: int, n: int) -> F.Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def scored(counts: DataFrame, cover: int = COVER) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the phrases of 2 words and more that no longer one covers.

    ``counts`` holds every part of each phrase. The score is of the cut with the least ``floor(2000000 a / (l + r))``, the
    first of equal ones. A phrase goes where a longer one that holds it has ``100 f(longer) >= cover * a``. Products are
    taken as decimals. Equi-joins on language and words, whose hot keys Spark can split; covers are aggregated first.
    """
    f = counts.where("phrase is not null").select("lang", "phrase", "length", "f")
    phrases = f.where("length > 1").withColumnRenamed("f", "a")
    cut = lambda k: F.struct(F.lit(k).alias("k"), _parts("phrase", 1, k).alias("head"), F.slice(F.split("phrase", " "), k + 1, LONGEST).alias("tail"))
    cuts = F.filter(F.array(*(cut(k) for k in range(1, LONGEST))), lambda x: F.size(x["tail"]) > 0)
    cuts = phrases.select("lang", "phrase", "a", F.inline(cuts)).withColumn("tail", F.array_join("tail", " "))
    heads, tails = (f.select("lang", F.col("phrase").alias(p), F.col("f").alias(c)) for p, c in (("head", "l"), ("tail", "r")))
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    score = F.expr("cast(cast(2000000 as decimal(19, 0)) * cast(a as decimal(19, 0)) div cast(l + r as decimal(19, 0)) as long)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    inner = [F.struct(_parts("phrase", i, n).alias("phrase"), F.lit(n).alias("n"), F.lit(i + n - 1).alias("last")) for n in range(2, LONGEST) for i in range(1, LONGEST - n + 2)]
    longer = phrases.where("length > 2").select("lang", F.col("a").alias("f"), "length", F.inline(F.array(*inner)))
    longer = longer.where("n < length and last <= length").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    out = best.join(longer, ["lang", "phrase"], "left")
    covered = F.expr(f"cast(100 as decimal(19, 0)) * cast(most as decimal(19, 0)) >= cast({cover} as decimal(19, 0)) * cast(a as decimal(19, 0))")
    return out.where(~F.coalesce(covered, F.lit(False))).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases by score: ``lang, rank, phrase, a, l, r, n, score``; a top-k report.

    A null language is ``und``; null, empty and wordless texts have no phrases. Each row counts, repeated ones too; columns
    other than ``lang`` and ``text`` are ignored; an empty table gives an empty result.
    """
    with released(docs.sparkSession):
        counts = materialise(phrase_counts(docs, support))
        n = counts.where("phrase is null").select("lang", F.col("f").alias("n"))
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = scored(counts).withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
        return materialise(ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), keep=True)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 highest-scoring phrases of each language over all documents."""
    return collocations(load(spark, sf_dir, "documents"))


_CHARS = "chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE_SQL = f"""WITH pieces AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?' || {_CHARS} || ']')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ ' || chr(9) || ']'), lambda x: x <> '') AS w FROM pieces),
g AS (SELECT lang, k AS length, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, length, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE length = 1 GROUP BY lang),
c AS (SELECT lang, length, phrase, f AS a, string_split(phrase, ' ') AS p FROM f WHERE length > 1 AND f >= {SUPPORT}),
cuts AS (SELECT lang, length, phrase, a, k, array_to_string(p[1 : k], ' ') AS head, array_to_string(p[k + 1 : length], ' ') AS tail FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < length),
s AS (SELECT cuts.*, h.f AS l, t.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (h.f + t.f) AS BIGINT) AS score FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head AND h.length = k JOIN f t ON t.lang = cuts.lang AND t.phrase = tail AND t.length = cuts.length - k),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase, length ORDER BY score, k) AS rn FROM s) WHERE rn = 1),
inside AS (SELECT lang, a AS f, k AS length, unnest(list_transform(range(1, length - k + 2), lambda i: array_to_string(p[i : i + k - 1], ' '))) AS phrase FROM c, (SELECT unnest([2, 3]) AS k) WHERE k < length),
most AS (SELECT lang, length, phrase, max(f) AS most FROM inside GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN most m ON m.lang = b.lang AND m.phrase = b.phrase AND m.length = b.length WHERE coalesce(100 * CAST(most AS HUGEINT) < {COVER} * CAST(a AS HUGEINT), true))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= {TOP}"""
