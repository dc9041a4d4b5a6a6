"""Packing documents into sequences of bounded length, by linear grouping and best fit over the length histogram."""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialise, rank_within, slices, small_batches

CAPACITY, END_ID = 1024, 2
#: Bytes of words and ids kept by one Python worker; beyond it the store starts anew. Bounds memory, not results.
STORE_BYTES = 40_000_000

# A space between two other non-white characters: byte-level BPE always starts a token there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Texts in which not every space is such a space, or that hold a special token's mark.
_ODD = r"\s | \s|^ | $|<\|"


class IdStore:
    """Token ids of whole texts as little-endian 32-bit bytes, from a tokenizer and a store of space-led words.

    Texts are cut at plain single spaces, a batch at a time, and each word new to the store is tokenised once. A text
    with special-token marks goes to the tokenizer whole. Either way the ids are those of the whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of text that each id stands for: one a character of a byte-level vocabulary.
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.size[i] = len(token)
        self.led: dict[str, bytes] = {}  # ids of what follows a space, by what it is without the space
        self.held = 0

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, tokenised in runs; the bytes that ids stand for tell where each word ends."""
        if self.held > STORE_BYTES:
            self.led.clear()
            self.held = 0
        for at in range(0, len(words), 1000):
            own = words[at : at + 1000]
            ids = self._encode("".join([" " + w for w in own]))
            ends = np.cumsum([len(w.encode()) + 1 for w in own])
            cuts = np.searchsorted(np.cumsum(self.size[ids]), ends, side="right").tolist()
            raw, last = ids.tobytes(), 0
            for w, cut in zip(own, cuts, strict=True):
                self.led[w] = raw[4 * last : 4 * cut]
                last = cut
            self.held += len(raw) + int(ends[-1]) + 150 * len(own)

    def _found(self, words: list[str]) -> list[bytes]:
        found = list(map(self.led.get, words))
        if None in found:
            self._learn([w for w, ids in zip(words, found, strict=True) if ids is None])
            # where the store began anew, it lacks words that were found before
            found = [self.led.get(w, ids) for w, ids in zip(words, found, strict=True)]
        return found

    def ids(self, text: str) -> bytes:
        """Ids of one text, whatever its white space."""
        if "<|" in text:
            return self._encode(text).tobytes()
        start, *rest = _CUT.split(text)
        return self._encode(start).tobytes() + b"".join(map(dict(zip(set(rest), self._found(list(set(rest))), strict=False)).__getitem__, rest))

    def all_ids(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a batch; nulls count as empty."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for i in np.nonzero(odd)[0].tolist():
            out[i] = self.ids(texts[i].as_py())
        plain = np.nonzero(~odd)[0]
        parts = pc.split_pattern(texts.take(pa.array(plain)), " ")
        if not len(plain):
            return out
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets, words = offsets - offsets[0], parts.flatten()
        known = words.dictionary_encode()
        at = known.indices.to_numpy().astype(np.int64)
        begin = offsets[:-1]  # each text has a first part, which no space leads
        firsts, which = np.unique(at[begin], return_inverse=True)
        at[begin] = len(known.dictionary) + which
        table = self._found(known.dictionary.to_pylist()) + [self._encode(w).tobytes() for w in known.dictionary.take(pa.array(firsts)).to_pylist()]
        lengths = np.array([len(x) for x in table])[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets].tolist()
        buffer = pa.array(table, pa.large_binary()).take(pa.array(at)).buffers()[2]
        raw = buffer.to_pybytes() if buffer else b""
        for i, a, b in zip(plain.tolist(), ends, ends[1:]):
            out[i] = raw[a:b]
        return out


@functools.lru_cache(1)
def id_store(path: str) -> IdStore:
    """The store of this Python worker, which tasks that run in it one after another share."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
    return IdStore(path)


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of each document's token ids: ``doc_id, piece, start, length, ids_crc32``.

    A document is its ids and ``end_id``; null text is empty. One longer than ``capacity`` is cut so that all pieces
    but the first are full. Reads ``doc_id`` and ``text`` only. Each row is a document: repeated rows give repeated
    pieces, and a null ``doc_id`` stays null.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = id_store(tokenizer_path)
        for batch in slices(batches, 1, 8_000_000):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, ids in zip(batch.column(0).to_pylist(), store.all_ids(batch.column(1)), strict=True):
                ids += end
                n, at = len(ids) // 4, 0
                length = n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    values = (doc_id, piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]))
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                    at, length = at + length, capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)], names)

    small_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Runs of equal sequences: ``runs[i] = (lengths, count)`` stands for ``count`` sequences of pieces of ``lengths``."""

    def __init__(self, capacity: int):
        self.capacity, self.runs = capacity, []

    def add(self, lengths: list[int], count: int) -> None:
        self.runs.append([lengths, count])

    def sequences(self) -> int:
        return sum(c for _, c in self.runs)


def _fullest(sizes: list[int], left: list[int], room: int) -> list[int]:
    """How many of each size to take, within ``left``, so that as much of ``room`` as can be is used.

    Subset sums as bits of one integer, kept after each size to trace the choice back.
    """
    mask, reach = (1 << (room + 1)) - 1, [1]
    for s, n in zip(sizes, left, strict=True):
        r = reach[-1]
        for _ in range(min(n, room // s)):
            wider = (r | r << s) & mask
            if wider == r:
                break
            r = wider
        reach.append(r)
        if r >> room:
            break
    at, take = reach[-1].bit_length() - 1, [0] * len(sizes)
    for k in range(len(reach) - 2, -1, -1):
        while not reach[k] >> at & 1:
            at -= sizes[k]
            take[k] += 1
    return take


def _configurations(sizes: list[int], left: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Fill sequences with few sizes: the largest left, then the fullest configuration around it, as often as it can be."""
    out = []
    for k, s in enumerate(sizes):
        while left[k]:
            take = [0] * len(sizes)
            take[k] = 1
            left[k] -= 1
            for j, n in enumerate(_fullest(sizes, left, capacity - s)):
                take[j] += n
            left[k] += 1
            count = min(left[j] // n for j, n in enumerate(take) if n)
            for j, n in enumerate(take):
                left[j] -= n * count
            out.append((take, count))
    return out


def _grouped(counts: dict[int, int], groups: int | None) -> list[tuple[int, list[list[int]]]]:
    """Linear grouping: the lengths from the longest on, in groups of equal cardinality, each rounded up to its longest.

    Without a number of groups each length is one, which rounds nothing.
    """
    size = max(1, -(-sum(counts.values()) // groups)) if groups else 0
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, []))
                room = size or left
            n = min(left, room)
            out[-1][1].append([length, n])
            left, room = left - n, room - n
    return out


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups: int | None = 48, small: int | None = None) -> Plan:
    """Pack pieces, known by how many there are of each length, into few sequences of ``capacity``.

    Lengths over ``small`` are rounded up within groups of equal cardinality and packed by configurations of the few
    rounded sizes; the actual lengths then take their places, longest first, and the small ones go, longest first,
    where they fit best. Works on counts alone: at most ``capacity`` lengths, however many documents.
    """
    small = capacity // 8 if small is None else small
    plan = Plan(capacity)
    large = {n: c for n, c in histogram.items() if n > small and c}
    by_group = _grouped(large, groups) if large else []
    sizes, left = [s for s, _ in by_group], [sum(c for _, c in g) for _, g in by_group]
    for take, count in _configurations(sizes, left, capacity):
        slots = [k for k, n in enumerate(take) for _ in range(n)]
        while count:
            # as many sequences as each slot can fill with one actual length; slots of one group share its queue
            lengths, need = [], {}
            pos = {k: 0 for k in slots}
            spans = []
            for k in slots:
                queue = by_group[k][1]
                while not queue[pos[k]][1] - need.get((k, pos[k]), 0):
                    pos[k] += 1
                spans.append((k, pos[k]))
                need[(k, pos[k])] = need.get((k, pos[k]), 0) + 1
            times = count
            for (k, p), n in need.items():
                times = min(times, by_group[k][1][p][1] // n)
            lengths = [by_group[k][1][p][0] for k, p in spans]
            for (k, p), n in need.items():
                by_group[k][1][p][1] -= n * times
            plan.add(lengths, times)
            count -= times
    slack: dict[int, list[list]] = {}
    for run in plan.runs:
        slack.setdefault(capacity - sum(run[0]), []).append(run)
    rest: dict[int, int] = {}
    for length in sorted((n for n in histogram if n <= small and histogram[n]), reverse=True):
        left_n = histogram[length]
        while left_n and (room := min((r for r in slack if r >= length), default=None)) is not None:
            run = slack[room].pop()
            if not slack[room]:
                del slack[room]
            fit = min(room // length, -(-left_n // run[1])) if run[1] <= left_n else 1
            times = min(run[1], left_n // fit)
            if times < run[1]:
                other = [list(run[0]), run[1] - times]
                plan.runs.append(other)
                slack.setdefault(room, []).append(other)
                run[1] = times
            run[0] = run[0] + [length] * fit
            left_n -= fit * times
            slack.setdefault(room - fit * length, []).append(run)
        if left_n:
            rest[length] = left_n
    sizes = sorted(rest, reverse=True)
    for take, count in _configurations(sizes, [rest[s] for s in sizes], capacity):
        plan.add([s for s, n in zip(sizes, take, strict=True) for _ in range(n)], count)
    return plan


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with the fewest sequences of several group counts and bounds between large and small.

    The last group count has each length as its own group.
    """
    plans = (plan_packing(histogram, capacity, g, capacity // part) for g in (24, 96, None) for part in (8, 3, 2))
    return min(plans, key=Plan.sequences)


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of ``length`` 1 to ``capacity``: few sequences, offsets gapless from 0.

    The histogram of lengths (``capacity`` rows at most) goes to the driver, which plans runs of equal sequences.
    Each piece's rank among those of its length, found by many tasks, is looked up in the runs. ``order`` should
    identify a piece. ``pieces`` is read several times and should be a written table.
    """
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    slots: dict[int, list[tuple[int, int, int]]] = {}
    ranked_to: dict[int, int] = {}
    base = 0
    for lengths, count in best_plan(histogram, capacity).runs:
        at = 0
        for n in lengths:
            start = ranked_to.get(n, 0)
            slots.setdefault(n, []).append((start, base - start, at))
            ranked_to[n] = start + count
            at += n
        base += count
    table = {n: np.array(s, dtype=np.int64).T for n, s in slots.items()}
    ranked = rank_within(pieces, ["length"], order, "__rank", seed=11).select(*pieces.columns, "__rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = length == n
                starts, shift, at = table[int(n)]
                slot = np.searchsorted(starts, rank[own], side="right") - 1
                seq[own], off[own] = rank[own] + shift[slot], at[slot]
            kept = [c for c in batch.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(seq), pa.array(off)], [*kept, "sequence_id", "offset"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of all documents, packed: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    An empty table gives an empty result; a null or empty text is one piece of one id.
    """
    return pack(materialise(tokenised_pieces(docs, tokenizer_path, capacity)), ["doc_id", "piece"], capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    import public_tokenizers

    return pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
