"""Quality classifier: averaged vectors of hashed words, word pairs and character n-grams, a softmax, trained by SGD in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, release, slices, small_batches

BUCKETS, DIM, ORDERS = 1 << 17, 8, (1, 2, 3, 4)
#: Bounds on what is fitted on, for each label: rows, bytes of texts in all, bytes of one text. Everything else reads all rows.
SAMPLE_ROWS, SAMPLE_BYTES, TEXT_BYTES = 1500, 16_000_000, 1_000_000
#: Score from which a document is predicted to be of label 1.
ACCEPT = 0.7
_MIX, _ODD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
#: Stands for a word that repeats the one before it, so that all such pairs share one vector.
_AGAIN = np.uint64(0xA5A5A5A5A5A5A5A5)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """``(word, offsets, own, pair)``: the distinct word at each place, where texts begin and end, what a distinct word has for
    features, and the feature of each place's pair with the word before (-1 for a text's first word).

    Words are parted by ASCII white space and keep their case. A distinct word's features are itself and the character
    n-grams of it between two marks. Null and blank texts have no words.
    """
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    words = parts.flatten()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # a text's ends may give empty parts
    offsets = np.concatenate([[0], np.cumsum(real)])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    known = words.filter(pa.array(real)).dictionary_encode()
    distinct, at = known.dictionary.to_pylist(), known.indices.to_numpy().astype(np.int64)
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    chars = np.frombuffer(("\n" + "\n".join(distinct) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mark = chars == 10
    of = np.cumsum(mark) - 1  # a mark before a word counts to it
    rows, found = [np.arange(len(distinct))], [_bucket(h)]
    g = np.zeros(len(chars), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        g = (g[: len(chars) - n + 1] ^ chars[n - 1 :]) * _ODD
        g = g ^ (g >> np.uint64(31))
        if n in ORDERS and len(distinct):
            inner = np.zeros(len(g), bool)
            for k in range(1, n - 1):
                inner |= mark[k : k + len(g)]
            ok = np.nonzero(~inner & ~(mark[: len(g)] & (n == 1)) & ~(mark[: len(g)] & mark[n - 1 :]))[0]
            rows.append(of[ok]), found.append(_bucket(g[ok] + np.uint64(n)))
    row, found = np.concatenate(rows), np.concatenate(found)
    ok = row < len(distinct)
    order = np.argsort(row[ok], kind="stable")
    own = np.split(found[ok][order], np.cumsum(np.bincount(row[ok], minlength=len(distinct)))[:-1]) if distinct else []
    pair = np.full(len(at), -1, np.int64)
    if len(at) > 1:
        now, last = h[at[1:]], h[at[:-1]]
        pair[1:] = _bucket(np.where(now == last, _AGAIN, (last * _ODD) ^ now))
        pair[offsets[:-1][np.diff(offsets) > 0]] = -1
    return at, offsets, own, pair


class QualityModel:
    """Embeddings ``E``, weights ``W`` and bias ``b`` of a softmax over labels 0 and 1, with a temperature."""

    def __init__(self, seed: int = 0):
        self.E = np.random.default_rng(seed).normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.W, self.b, self.temperature, self.prior = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32), 1.0, 0.0
        self.constant: float | None = None

    def fit(self, texts: list[str], labels: list[int], shares: tuple[float, float], epochs: int = 8, rate: float = 4.0, seed: int = 1) -> None:
        """SGD over whole documents, both labels weighing alike; the temperature from a tenth of each that is held back.

        ``shares`` are those of the labels among all that the sample was drawn from: texts without words get them for a
        score. Where a label is missing, the score is the share of label 1 for all.
        """
        y = np.array(labels, int)
        if len(set(labels)) < 2:
            self.constant = shares[1]
            return
        rng, bags = np.random.default_rng(seed), []
        for i in range(0, len(texts), 50):
            at, offsets, own, pair = features(pa.array(texts[i : i + 50], pa.string()))
            for s, e in zip(offsets.tolist(), offsets[1:].tolist()):
                bag = np.concatenate([np.zeros(0, np.int64), *(own[k] for k in at[s:e].tolist()), pair[s:e][pair[s:e] >= 0]])
                found, n = np.unique(bag, return_counts=True)
                bags.append((found.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
        held = np.zeros(len(y), bool)
        for k in (0, 1):
            own = rng.permutation(np.nonzero(y == k)[0])
            held[own[: len(own) // 10]] = True
        train = np.nonzero(~held)[0]
        weight = len(train) / 2 / np.maximum(1, np.bincount(y[train], minlength=2))
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for i in rng.permutation(train).tolist():
                g, share = bags[i]
                v = share @ self.E[g]
                p = self._softmax(v @ self.W + self.b)
                p[y[i]] -= 1
                p *= step * min(2.0, weight[y[i]])
                back = self.W @ p
                self.W -= 0.2 * np.outer(v, p).astype(np.float32)
                self.b -= (0.02 * p).astype(np.float32)
                self.E[g] -= np.outer(share, back).astype(np.float32)
        check = np.nonzero(held)[0]
        if len(check) >= 10:
            odds = np.array([(share @ self.E[g] @ self.W + self.b) @ (-1, 1) for g, share in (bags[i] for i in check.tolist())], float)
            sign, w = np.where(y[check] == 1, 1.0, -1.0), 1 / np.bincount(y[check], minlength=2)[y[check]]
            miss = 1 / (len(check) + 2)  # smoothed targets, so that it stays finite where all are right
            loss = lambda t: float((w * (np.logaddexp(0, -sign * odds / t) + miss * sign * odds / t)).sum())
            self.temperature = float(min(np.geomspace(0.25, 16, 49), key=loss))
        self.prior = float(np.log(max(shares[1], 1e-9) / max(shares[0], 1e-9)))

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max())
        return e / e.sum()

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 of each whole text; texts without words have that of the shares alone."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        table = (self.E @ (self.W[:, 1] - self.W[:, 0])).astype(np.float64)
        at, offsets, own, pair = features(texts)
        sums = np.array([table[x].sum() for x in own]) if own else np.zeros(0)
        n = np.array([len(x) for x in own], np.int64)
        total = np.concatenate([[0.0], np.cumsum(sums[at] + np.where(pair >= 0, table[pair], 0.0))])
        count = np.concatenate([[0], np.cumsum(n[at] + (pair >= 0))])
        mean = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(1, count[offsets[1:]] - count[offsets[:-1]])
        odds = np.where(np.diff(offsets) > 0, (mean + float(self.b[1] - self.b[0])) / self.temperature, self.prior)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def _fold() -> Column:
    """The remainder by 4 of the CRC-32 of the id's text; null ids count as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, total_bytes: int = SAMPLE_BYTES, text_bytes: int = TEXT_BYTES) -> QualityModel:
    """Fit on a sample drawn by a hash of ids: at most ``rows`` documents and ``total_bytes`` of text of each label, whole texts.

    Only documents whose remainder is not 2 are learned from. Texts over ``text_bytes`` and null ones are not drawn; a document
    with labels that contradict each other, or without one, is not learned from.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    sized = docs.where((_fold() != 2) & F.col("text").isNotNull()).select("doc_id", F.octet_length("text").alias("size")).join(known, "doc_id")
    counts = {int(r[0]): int(r[1]) for r in sized.groupBy("quality").count().collect()}
    model = QualityModel()
    if len(counts) < 2:
        model.constant = (0.0 if 0 in counts else 1.0) if counts else 0.5
        return model
    drawn = sized.where(F.col("size") <= text_bytes).withColumn("h", F.xxhash64("doc_id", F.lit(11)))
    share = F.when(F.col("quality") == 0, F.lit(2 * rows / counts[0])).otherwise(F.lit(2 * rows / counts[1]))
    drawn = drawn.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000)
    first = Window.partitionBy("quality").orderBy("h", "doc_id")
    drawn = drawn.withColumns({"at": F.row_number().over(first), "sum": F.sum("size").over(first.rowsBetween(Window.unboundedPreceding, 0))})
    ids = drawn.where((F.col("at") <= rows) & (F.col("sum") <= total_bytes)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    sample = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= text_bytes)).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    sample = sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # of repeated rows one
    found = sorted((r.doc_id, r.quality, r.text) for r in sample.collect())
    n = sum(counts.values())
    model.fit([t for *_, t in found], [q for _, q, _ in found], (counts[0] / n, counts[1] / n))
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Add ``score`` and ``predicted`` from each whole text; other columns stay, columns of those names are replaced.

    Null, empty and blank texts have the score of the labels' shares. Each row counts by itself.
    """
    kept = [f for f in docs.schema if f.name not in ("score", "predicted")]
    names, fitted = [f.name for f in kept], model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names.index("text")):
            found = fitted.scores(batch.column(names.index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array(found >= ACCEPT).cast(pa.int32())], [*names, "score", "predicted"])
        release()

    small_batches(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*names).mapInArrow(run, f"{schema}, score double, predicted int")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels of the three folds that are not held out.

    Each row is scored by itself, repeated or without ``doc_id``; an empty table gives an empty result.
    """
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, load(spark, sf_dir, "labels")))
    return out.select("doc_id", (_fold() == 2).alias("held_out"), "score", "predicted")
