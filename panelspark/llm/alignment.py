"""Cross-tokenizer alignment, Arrow-native: token lists flattened, ends by cumulative sums, joined on document and end, links counted."""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialise, release, released, slices, small_batches
from .packing import _ODD, STORE_BYTES, IdStore

#: Bytes of texts that are aligned at once; bounds a task's memory.
BLOCK = 2_000_000
#: Fixed value: how the piece vocabulary writes a space.
MARK = "▁"
#: What stands before an id in a document's groups: nothing, a new group, a further id, the other side of a group.
_BEFORE = ("", ";", ",", "|")


class _ByteTokens(IdStore):
    """Byte-level BPE in which the strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        own, shown = {}, self.tokenizer.get_vocab()
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        #: Byte-level vocabularies show other bytes by the characters from 256 on, in order.
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        assert sorted(byte) == sorted(ByteLevel.alphabet())
        for token, i in shown.items():
            own[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.bytes = [own.get(i, b"") for i in range(max(own) + 1)]

    def words(self, words: list[str]) -> list[bytes]:
        return self._found(words)

    def whole(self, text: str) -> bytes:
        return self._encode(" " + text).tobytes()


class _PieceTokens:
    """A piece vocabulary that puts a space before each text; no piece holds a space after another character."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if m.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        #: Words can be encoded apart only where no piece goes over from one to the next.
        self.apart = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.led: dict[str, bytes] = {}
        self.held = 0

    def words(self, words: list[str]) -> list[bytes]:
        new = [w for w in words if w not in self.led]
        if self.held > STORE_BYTES:
            self.led.clear()
            self.held, new = 0, words
        for at in range(0, len(new), 10_000):
            own = new[at : at + 10_000]
            ids = self.model.encode(own, num_threads=1)
            ends = np.cumsum([4 * len(x) for x in ids]).tolist()
            raw = np.fromiter(itertools.chain.from_iterable(ids), "<u4").tobytes()
            self.led.update(zip(own, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))
            self.held += len(raw) + sum(map(len, own)) + 150 * len(own)
        return list(map(self.led.__getitem__, words))

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text), "<u4").tobytes()


@functools.lru_cache(1)
def _tokenizers(a: str, b: str) -> tuple[_ByteTokens, _PieceTokens, pa.Array]:
    """Both tokenizers of this Python worker, and each id as text after each of ``_BEFORE``."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
    x, y = _ByteTokens(a), _PieceTokens(b)
    n = max(len(x.bytes), len(y.bytes))
    return x, y, pa.array([s + str(i) for s in _BEFORE for i in range(n)], pa.large_string())


def _token_lists(texts: pa.Array, stores: list, apart: bool) -> list[pa.LargeListArray]:
    """Ids of a space and each text by each tokenizer, one list a text.

    Texts of plain single spaces are cut there, once for all tokenizers, and each new word is encoded once; others go whole.
    """
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if apart else np.ones(len(texts), bool)
    plain, lists = np.nonzero(~odd)[0], []
    parts = pc.split_pattern(texts.take(pa.array(plain)), " ")
    offsets = parts.offsets.to_numpy().astype(np.int64) - (parts.offsets[0].as_py() if len(plain) else 0)
    known = parts.flatten().dictionary_encode()
    words = known.dictionary.to_pylist()
    for store in stores:
        out: list[bytes] = [b""] * len(texts)
        for i in np.nonzero(odd)[0].tolist():
            out[i] = store.whole(texts[i].as_py())
        if len(plain):
            taken = pa.array(store.words(words), pa.large_binary()).take(known.indices)
            ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[offsets].tolist()
            raw = memoryview(taken.buffers()[2] or b"")
            for i, s, e in zip(plain.tolist(), ends, ends[1:]):
                out[i] = raw[s:e]
        starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])]).astype(np.int64)
        lists.append(pa.LargeListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(out), "<u4").astype(np.int64))))
    return lists


def _spelled(lists: pa.LargeListArray, table: list[bytes], texts: list[bytes]) -> np.ndarray:
    """Whether the bytes of a text's tokens are a space and the text."""
    tokens = pa.array(table, pa.large_binary()).take(lists.flatten())
    ends = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1)[lists.offsets.to_numpy()].tolist()
    raw = (tokens.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return np.array([raw[s:e] == b" " + t for s, e, t in zip(ends, ends[1:], texts, strict=False)], bool)


class Aligned:
    """The alignment of a batch of texts: ``doc, a, b`` of each link, and by text the tokens, groups and links.

    ``parent`` is the text of each token, ``end`` the byte of its text where it ends. Ends that both sides have, found
    by a hash join on text and end, cut the tokens into groups.
    """

    def __init__(self, texts: pa.Array, a_path: str, b_path: str):
        a, b, self._names = _tokenizers(a_path, b_path)
        raw = texts.fill_null("")
        lists = _token_lists(raw, [a, b], b.apart)
        encoded = raw.cast(pa.binary()).to_pylist()
        good = np.array([bool(t) for t in encoded], bool)
        for side, store in zip(lists, (a, b), strict=True):
            good &= _spelled(side, store.bytes, encoded)
        if not good.all():  # no tokens
            keep = pa.array(good)
            lists = [pc.if_else(keep, side, pa.scalar([], side.type)) for side in lists]
        self.n_texts, self.n = len(texts), [np.diff(side.offsets.to_numpy()) for side in lists]
        self.ids, self.parent, self.end, span = [], [], [], []
        for side, store in zip(lists, (a, b), strict=True):
            ids, parent = side.flatten().to_numpy(zero_copy_only=False), pc.list_parent_indices(side).to_numpy(zero_copy_only=False)
            size = np.array([len(x) for x in store.bytes], np.int64)[ids]
            run = np.cumsum(size)  # over all texts; less what the texts before have: from each text's beginning
            before = np.concatenate([[0], run])[side.offsets.to_numpy()[:-1]]
            self.ids.append(ids), self.parent.append(parent), self.end.append(run - before[parent])
            span.append((run - size, run))
        keyed = [pa.table({"text": p, "end": e, f"at_{k}": np.arange(len(p))}) for k, p, e in zip("ab", self.parent, self.end, strict=True)]
        cut = keyed[0].join(keyed[1], ["text", "end"], join_type="inner", use_threads=False)
        #: The last token of each group, of either side.
        self.last = [np.sort(cut.column(f"at_{k}").to_numpy()) for k in "ab"]
        self.n_groups = np.bincount(self.parent[0][self.last[0]], minlength=self.n_texts)
        (s, e), (other_s, other_e) = span
        low, high = np.searchsorted(other_e, s, side="right"), np.searchsorted(other_s, e, side="left")
        n = high - low
        at = np.repeat(np.arange(len(s)), n)
        to = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        self.links = pa.table({"text": self.parent[0][at], "pair": self.ids[0][at] << 32 | self.ids[1][to]})
        self.n_links = np.bincount(self.parent[0][at], minlength=self.n_texts)

    def groups(self) -> list[memoryview]:
        """Each text's groups, ``a1,a2|b1;a3|b2,b3``: the ids of either side in order."""
        n_names = len(self._names) // len(_BEFORE)
        total = len(self.ids[0]) + len(self.ids[1])
        code, own = np.empty(total, np.int64), np.zeros(self.n_texts + 1, np.int64)
        first = [np.concatenate([[0], last + 1]) for last in self.last]  # of each group, and behind the last one
        for side in (0, 1):
            count = np.diff(first[side])
            group = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(group)) + first[1 - side][group + side]
            before = np.full(len(group), 2)
            before[first[side][:-1]] = 3 if side else 1
            code[place] = before * n_names + self.ids[side]
        own[1:] = np.cumsum(self.n[0] + self.n[1])
        begins = own[:-1][np.diff(own) > 0]
        code[begins] -= n_names  # a text's first id: nothing stands before it
        taken = self._names.take(pa.array(code))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[own].tolist()
        raw = memoryview(taken.buffers()[2] or b"")
        return [raw[s:e] for s, e in zip(ends, ends[1:])]


_BLOCKS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, pairs array<long>, docs array<long>, counts binary"


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, spell: bool = False) -> DataFrame:
    """Texts aligned a block at a time, one row each: what is known of each text, the block's distinct pairs of ids with the
    number of its texts that hold them linked, and how often each text does. ``groups`` are SHA-256 digests, or with ``spell``
    the groups themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, packer = TaskContext.get().partitionId() << 32, 0, zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, 1, BLOCK):
            own = Aligned(batch.column(1), a_path, b_path)
            per_text = own.links.group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")])
            partial = per_text.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
            pairs = partial.column("pair").to_numpy()
            per_text = per_text.sort_by("text")
            columns = (per_text.column("text").to_numpy(), np.searchsorted(pairs, per_text.column("pair").to_numpy()), per_text.column("count_all").to_numpy())
            counts = packer.compress(b"".join(c.astype("<u4").tobytes() for c in columns))
            shown = [(str(g, "ascii") if spell else hashlib.sha256(g).hexdigest()) if len(g) else "" for g in own.groups()]
            values = [[task + made], [batch.column(0).to_pylist()], [own.n[0]], [own.n[1]], [own.n_groups], [own.n_links], [shown], [pairs], [partial.column("count_all").to_numpy()], [counts]]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.list_(pa.int64())] * 2, pa.binary()]
            names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "docs", "counts"]
            out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)
            del own, per_text, partial, pairs, columns, values
            release()
            yield out
            made += 1

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, a, b, docs, best``: documents that hold each pair of ids linked, and whether no pair of its ``a`` has more."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("docs"))
    pairs = materialise(pairs.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "docs"))
    most = pairs.groupBy("a").agg(F.max("docs").alias("most"))
    return pairs.join(most, "a").select("pair", "a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def align(docs: DataFrame, a_path: str, b_path: str, spell: bool = False) -> DataFrame:
    """Align the tokens of two tokenizers by the bytes that they stand for: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``.

    ``a_path``: a byte-level BPE of ``tokenizers``, which gets a space and the text; ``b_path``: a ``sentencepiece`` model,
    which puts the space itself. Tokens whose bytes overlap are linked. A pair's count is the number of documents that hold
    it linked; ``n_best`` counts links of a pair that no other pair of its first id exceeds, ``count_sum`` adds the counts over links.
    Null and empty texts, and texts that the tokens do not spell, have zeros and empty groups. Each row is a document,
    repeated or without ``doc_id``; other columns are ignored; an empty table gives an empty result.

    Counts are partial by block, summed by Spark, and go back to the blocks that asked: rows of one pair are as many as
    there are blocks.
    """
    spark = docs.sparkSession

    def finish(t: pa.Table, known: pa.Table) -> pa.Table:
        per = {c: t.column(c).combine_chunks().flatten() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")}
        n = len(per["doc_id"])
        count, best = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, np.int64)
        at = known.column("at").to_numpy()
        count[at], best[at] = known.column("docs").to_numpy(), known.column("best").to_numpy(zero_copy_only=False)
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(t.column("counts")[0].as_py()), "<u4").reshape(3, -1).astype(np.int64)
        text, pair, times = raw
        sums = np.zeros((2, n), np.int64)
        if len(text):
            heads = np.concatenate([[0], np.nonzero(np.diff(text))[0] + 1])
            for k, v in enumerate((best, count)):
                sums[k][text[heads]] = np.add.reduceat(v[pair] * times, heads)
        release()
        return pa.table({"doc_id": per["doc_id"], "n_a": per["n_a"], "n_b": per["n_b"], "n_groups": per["n_groups"], "n_links": per["n_links"], "n_best": sums[0], "count_sum": sums[1], "groups": per["groups"]})

    with released(spark):
        blocks = materialise(aligned_blocks(docs, a_path, b_path, spell))
        asked = blocks.select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair"))
        told = asked.join(pair_counts(blocks).select("pair", "docs", "best"), "pair").drop("pair")
        per_block = blocks.drop("pairs", "docs").groupBy("block").cogroup(told.groupBy("of"))
        return materialise(per_block.applyInArrow(finish, _RESULT), keep=True)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned between the public byte-level and piece vocabularies."""
    import public_tokenizers

    paths: Callable[[str], str] = public_tokenizers.path
    out = align(load(spark, sf_dir, "documents"), paths("byte_bpe_50k.json"), paths("piece_bpe_32k.model"))
    return out.withColumnRenamed("groups", "groups_sha256")
