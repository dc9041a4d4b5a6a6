"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, byte fallback, white-space marks."""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, slices, small_batches

MARK = "▁"
#: Bytes of words and ids kept by one task; beyond it the store starts anew. Bounds memory, not results.
STORE_BYTES = 40_000_000
_PART = re.compile(f"{MARK}*[^{MARK}]*")


def double_array(keys: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """``base, check, value`` of a trie over bytes: node ``s`` steps by byte ``c`` to ``base[s] + c`` if that checks ``s``."""
    base, check, value, free = [0] * 1024, [-1] * 1024, [-1] * 1024, 1
    check[0] = 0
    todo = [(0, sorted(keys.items()), 0)]
    while todo:
        node, items, depth = todo.pop()
        groups: dict[int, list] = {}
        for k, v in items:
            if len(k) == depth:
                value[node] = v
            else:
                groups.setdefault(k[depth], []).append((k, v))
        if not groups:
            continue
        codes, b = list(groups), max(1, free - min(groups))
        tried = 0
        while True:
            if b + 256 >= len(check):
                for a, fill in ((base, 0), (check, -1), (value, -1)):
                    a.extend([fill] * len(a))
            if all(check[b + c] < 0 for c in codes):
                break
            b, tried = b + 1, tried + 1
        base[node] = b
        for c in codes:
            check[b + c] = node
        while free < len(check) and check[free] >= 0:
            free += 1
        if tried > 50:  # too full here: later nodes are placed from here on
            free = max(free, b)
        todo += [(b + c, groups[c], depth + 1) for c in codes]
    return base, check, value


class Unigram:
    """A vocabulary of pieces with log scores; ``pieces[i]`` is the piece of id ``i``, ``byte_ids[b]`` of a lone byte."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], unknown: int, special: frozenset[int] = frozenset()):
        self.pieces, self.scores, self.byte_ids, self.unknown = pieces, scores, byte_ids, unknown
        plain = {p.encode(): i for i, p in enumerate(pieces) if p and i not in special}
        self.base, self.check, self.value = double_array(plain)
        self.penalty = min((scores[i] for i in plain.values()), default=0.0) - 10.0
        # pieces with a mark behind another character would reach over words
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in map(bytes.decode, plain))
        as_byte = {i: bytes([b]) for b, i in enumerate(byte_ids) if i >= 0}
        self.raw = [as_byte.get(i, b"" if i in special else p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)]

    def viterbi(self, part: str) -> list[int]:
        """Ids of the segmentation with the greatest sum of scores; of equals, the one with the longest last pieces.

        A character that no piece covers costs ``penalty`` and becomes its bytes.
        """
        b = part.encode()
        n, base, check, value, scores = len(b), self.base, self.check, self.value, self.scores
        best, back, low = [0.0] + [-1e300] * n, [(0, 0)] * (n + 1), self.penalty
        for i in range(n):
            if b[i] & 0xC0 == 0x80:
                continue
            score, node, j = best[i], 0, i
            width = 1 if b[i] < 0x80 else 2 if b[i] < 0xE0 else 3 if b[i] < 0xF0 else 4
            alone = False
            while j < n:
                to = base[node] + b[j]
                if check[to] != node or not to:
                    break
                node, j = to, j + 1
                if (v := value[node]) >= 0:
                    alone = alone or j - i == width
                    if score + scores[v] > best[j]:
                        best[j], back[j] = score + scores[v], (i, v)
            if not alone and score + low > best[i + width]:
                best[i + width], back[i + width] = score + low, (i, -1)
        out: list[int] = []
        while n:
            i, v = back[n]
            out += [v] if v >= 0 else [self.byte_ids[c] if self.byte_ids[c] >= 0 else self.unknown for c in reversed(b[i:n])]
            n = i
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become blanks, lone bytes join to characters, the blank that encoding set first goes."""
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def from_model(path: str) -> Unigram:
    """Read pieces and scores of a public vocabulary file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(p.get_piece_size())
    byte_ids = [-1] * 256
    for i in ids:
        if p.is_byte(i):
            byte_ids[int(p.id_to_piece(i)[3:-1], 16)] = i
    special = frozenset(i for i in ids if p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))
    return Unigram([p.id_to_piece(i) for i in ids], [p.get_score(i) for i in ids], byte_ids, p.unk_id(), special)


class Encoder:
    """Encodes whole texts, a batch at a time and word by word where the vocabulary allows, with a bounded store of words.

    The file's scores are taken as log scores. The public vocabulary file that the query uses gives merge ranks there,
    so on it the best segmentation is the one of the least sum of ranks, not of the greatest likelihood.
    """

    def __init__(self, model: Unigram):
        self.model, self.words, self.held = model, {}, 0
        self.base, self.check, self.value = (np.array(a, np.int32) for a in (model.base, model.check, model.value))
        self.scores = np.array(model.scores, np.float64)
        self.bytes = np.array([i if i >= 0 else model.unknown for i in model.byte_ids], np.int32)

    def _all_viterbi(self, parts: list[bytes]) -> list[bytes]:
        """``Unigram.viterbi`` of parts of similar length at once: one step of all for each place and piece length."""
        n = np.array([len(p) for p in parts], np.int64)
        m, width = len(parts), int(n.max())
        text = np.zeros((m, width + 4), np.uint8)
        inside = np.arange(width) < n[:, None]
        text[:, :width][inside] = np.frombuffer(b"".join(parts), np.uint8)
        best = np.full((m, width + 5), -1e300)
        best[:, 0] = 0.0
        back, piece = np.zeros((m, width + 5), np.int32), np.full((m, width + 5), -1, np.int32)
        for i in range(width):
            rows = np.nonzero((n > i) & (text[:, i] & 0xC0 != 0x80))[0]
            first = text[rows, i]
            wide = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
            alone, of, node, j = np.zeros(len(rows), bool), np.arange(len(rows)), np.zeros(len(rows), np.int32), i
            while len(of):
                to = self.base[node] + text[rows[of], j]
                ok = (self.check[to] == node) & (to > 0) & (n[rows[of]] > j)
                of, node, j = of[ok], to[ok], j + 1
                ends = self.value[node] >= 0
                at, v = of[ends], self.value[node[ends]]
                alone[at[j - i == wide[at]]] = True
                score = best[rows[at], i] + self.scores[v]
                better = score > best[rows[at], j]
                r = rows[at[better]]
                best[r, j], back[r, j], piece[r, j] = score[better], i, v[better]
            rows, wide = rows[~alone], wide[~alone]
            score = best[rows, i] + self.model.penalty
            better = score > best[rows, i + wide]
            rows, to = rows[better], (i + wide)[better]
            best[rows, to], back[rows, to], piece[rows, to] = score[better], i, -1
        row, at, found = [], [], []
        rows, end = np.arange(m), n.copy()
        while len(rows):
            start, v = back[rows, end], piece[rows, end]
            whole = v >= 0
            row.append(rows[whole]), at.append(start[whole]), found.append(v[whole])
            for k in range(4):  # a character that no piece covers becomes its bytes
                own = ~whole & (start + k < end)
                row.append(rows[own]), at.append(start[own] + k), found.append(self.bytes[text[rows[own], start[own] + k]])
            end = start.astype(np.int64)
            rows, end = rows[end > 0], end[end > 0]
        row, at, found = np.concatenate(row), np.concatenate(at), np.concatenate(found).astype("<i4")
        order = np.argsort(row * (width + 1) + at)
        ids, cuts = found[order].tobytes(), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=m))]) * 4
        return [ids[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]

    def _learn(self, parts: list[str]) -> None:
        if self.held > STORE_BYTES:
            self.words.clear()
            self.held = 0
        coded = sorted(((p.encode(), p) for p in parts), key=lambda x: len(x[0]))
        short = bisect.bisect_right(coded, 64, key=lambda x: len(x[0]))
        for at in range(0, short, 20_000):
            own = coded[at : min(at + 20_000, short)]
            self.words.update(zip([p for _, p in own], self._all_viterbi([b for b, _ in own]), strict=True))
        for _, p in coded[short:]:
            self.words[p] = np.array(self.model.viterbi(p), "<i4").tobytes()
        self.held += sum(len(b) + len(self.words[p]) + 150 for b, p in coded)

    def _found(self, parts: list[str]) -> list[bytes]:
        found = list(map(self.words.get, parts))
        if None in found:
            self._learn([p for p, ids in zip(parts, found, strict=True) if ids is None])
            found = [self.words.get(p, ids) for p, ids in zip(parts, found, strict=True)]
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text, whatever its blanks."""
        if not text:
            return np.zeros(0, np.int32)
        marked = MARK + text.replace(" ", MARK)
        parts = _PART.findall(marked) if self.model.by_word else [marked]
        one = list(dict.fromkeys(p for p in parts if p))
        known = dict(zip(one, self._found(one), strict=True))
        return np.frombuffer(b"".join([known[p] for p in parts if p]), np.int32)

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a batch; nulls count as empty."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, f"^ |  |^$|{MARK}").to_numpy(zero_copy_only=False) if self.model.by_word else np.ones(len(texts), bool)
        out: list = [None] * len(texts)
        for i in np.nonzero(odd)[0].tolist():
            out[i] = self.encode(texts[i].as_py())
        plain = np.nonzero(~odd)[0]
        if len(plain):
            parts = pc.split_pattern(texts.take(pa.array(plain)), " ")
            offsets, known = parts.offsets.to_numpy().astype(np.int64), parts.flatten().dictionary_encode()
            table = pa.array(self._found([MARK + w for w in known.dictionary.to_pylist()]), pa.large_binary()).take(known.indices)
            ends = table.buffers()[1] and np.frombuffer(table.buffers()[1], np.int64)[: len(table) + 1]
            ids = np.frombuffer(table.buffers()[2], np.int32)
            ends = (ends[offsets - offsets[0]] // 4).tolist()
            for i, a, b in zip(plain.tolist(), ends, ends[1:]):
                out[i] = ids[a:b]
        return out


def encode_documents(docs: DataFrame, model: Unigram) -> DataFrame:
    """``doc_id, ids`` of each whole text; null and empty texts have no ids. Each row is coded by itself, repeated or without id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in slices(batches, 1, 8_000_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoder.encode_all(batch.column(1)), pa.list_(pa.int32()))], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: Unigram) -> DataFrame:
    """``doc_id, text`` of the results of ``encode_documents``; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if x.as_py() is None else model.decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again: counts and checksums of the ids and of the text that comes back.

    Null and empty texts have no ids and come back empty; each row counts by itself, repeated or without ``doc_id``.
    Ids are those of the greatest sum of the file's scores, which are merge ranks (see ``Encoder``).
    """
    import public_tokenizers

    model = from_model(public_tokenizers.path("piece_bpe_32k.model"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, raw = Encoder(model), pa.array(model.raw, pa.large_binary())
        lone = np.isin(np.arange(len(model.pieces)), [i for i in model.byte_ids if i >= 0])
        for batch in slices(batches, 1, 8_000_000):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for text, ids in zip(batch.column(1), encoder.encode_all(batch.column(1)), strict=True):
                text = text.as_py() or ""
                back = raw.take(pa.array(ids)).buffers()[2].to_pybytes().decode("utf-8", "replace") if len(ids) else ""
                back = back[1:] if back[:1] == " " else back
                for c, v in zip(rows, (len(ids), int(lone[ids].sum()), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(back.encode()), back == text), strict=True):
                    c.append(v)
            arrays = [pa.array(c, t) for c, t in zip(rows, (*[pa.int64()] * 4, pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "decoded_crc32", "round_trip"])

    small_batches(spark)
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(run, "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
