"""Language ID: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy, with rejection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, release, small_batches

BUCKETS, DIM, ORDERS = 1 << 15, 12, (1, 2, 3, 4)
#: Bound on the labelled rows that are fitted on, for each language. Everything else reads all rows.
SAMPLE_PER_LANG = 600
#: Share of the documents in a learned language that the rejection bound may cost.
REJECT_SHARE = 0.01
#: Windows that the n-grams of a learned text are dealt to at most; none is left out.
WINDOWS = 8
#: Most frequent languages that are learned at most.
MOST_LANGS = 1000
UNKNOWN = "und"


def _grams(text: str) -> np.ndarray:
    """Bucket of each character n-gram of the lower-cased letters, words set off by blanks."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(a)
    keep = letter | np.concatenate([[False], letter[:-1]]) if len(a) else letter
    a = np.where(letter, a, 32)[keep].astype(np.uint32)
    a = np.concatenate([[32], a]).astype(np.uint32)
    h, out = np.zeros(len(a), np.uint32), []
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(a) - n + 1] if n > 1 else h) * np.uint32(0x01000193) ^ a[n - 1 :]
        if n in ORDERS and len(h):
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
            out.append((x >> np.uint32(17)).astype(np.int32))
        if len(h) < 1 or n >= len(a):
            break
    return np.concatenate(out)


def _letters(a: np.ndarray) -> np.ndarray:
    """Letters by code point: ASCII letters, and all from U+00AA on but signs that are no letters."""
    ascii_letter = ((a >= 97) & (a <= 122)) | ((a >= 65) & (a <= 90))
    high = np.nonzero(a >= 128)[0]
    out = ascii_letter.copy()
    if len(high):
        points, back = np.unique(a[high], return_inverse=True)
        out[high] = np.array([chr(p).isalpha() if not 0xD800 <= p < 0xE000 else False for p in points])[back]
    return out


def has_letters(text: str | None) -> bool:
    return bool(text) and bool(_letters(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)).any())


class LanguageModel:
    """Embeddings ``E``, weights ``W`` and bias ``b`` of a softmax over ``langs``; ``temperature`` and ``reject`` calibrate it.

    Scores under ``reject`` are of no learned language.
    """

    def __init__(self, langs: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.langs, self.temperature, self.reject = langs, 1.0, 0.0
        self.E = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.W, self.b = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)

    def fit(self, texts: list[str], labels: list[str], epochs: int = 6, rate: float = 2.0, window: int = 400, seed: int = 1) -> None:
        """SGD over windows of the texts' n-grams; temperature and rejection bound from whole documents held back.

        A tenth of each language's documents, but 25 or half where that is too few, is not learned from but scored whole.
        Whole texts are learned: all n-grams of a text, dealt to windows of about ``window`` so that short texts are seen
        too. A text has at most ``WINDOWS``, so that long ones do not dominate; beyond that its windows are larger.
        """
        rng, index = np.random.default_rng(seed), {lang: i for i, lang in enumerate(self.langs)}
        docs = [(_grams(text), index[label]) for text, label in zip(texts, labels, strict=True)]
        spelled = np.array([has_letters(text) for text in texts], bool)
        of, held = np.array([y for _, y in docs], int), np.zeros(len(docs), bool)
        for y in range(len(self.langs)):
            own = rng.permutation(np.nonzero((of == y) & spelled)[0])
            held[own[: max(len(own) // 10, min(25, len(own) // 2))]] = True
        rows = []
        for (g, y), h in zip(docs, held, strict=True):
            if h:
                continue
            cuts = np.array_split(rng.permutation(g), min(WINDOWS, -(-len(g) // window))) if len(g) > 2 * window else [g]
            rows += [(*np.unique(c, return_counts=True), y) for c in cuts]
        for epoch in range(epochs):
            step = np.float32(rate * (1 - epoch / epochs))
            for i in rng.permutation(len(rows)):
                g, n, y = rows[i]
                share = (n / n.sum()).astype(np.float32)
                v = share @ self.E[g]
                z = v @ self.W + self.b
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                back = self.W @ p
                self.W -= step * 0.2 * np.outer(v, p)
                self.b -= step * 0.02 * p
                self.E[g] -= np.outer(step * share, back)
        check = [d for d, h in zip(docs, held, strict=True) if h]
        if check:
            self._calibrate(np.array([self.E[g].mean(axis=0) @ self.W + self.b for g, _ in check], float), np.array([y for _, y in check]))

    def _calibrate(self, logits: np.ndarray, y: np.ndarray) -> None:
        """Temperature and rejection bound from the logits and languages of held-back documents.

        The temperature has the least log loss against targets smoothed by ``1 / (n + 2)``, so it stays finite where
        all are right. Of ``n`` scores the bound is the ``floor(REJECT_SHARE * (n + 1))``-th least: a further document
        like these scores less with probability of at most ``REJECT_SHARE``. Where that rank is 0, as for ``n`` under
        99, the bound is the least score moved down by its distance from the median, both as log odds. Under 10 scores
        say too little: then the bound is 0.
        """
        n, k = logits.shape
        if k < 2:
            return
        smooth = np.full((n, k), 1 / (n + 2) / (k - 1))
        smooth[np.arange(n), y] = 1 - 1 / (n + 2)

        def loss(t: float) -> float:
            z = logits / t
            z = z - z.max(axis=1, keepdims=True)
            return float((np.log(np.exp(z).sum(axis=1)) - (smooth * z).sum(axis=1)).mean())

        self.temperature = float(min(np.geomspace(0.25, 32, 57), key=loss))
        z = np.sort(logits / self.temperature, axis=1)
        odds = np.sort(-np.log(np.exp(z[:, :-1] - z[:, -1:]).sum(axis=1)))
        rank = int(REJECT_SHARE * (n + 1))
        if n < 10:
            return
        bound = odds[rank - 1] if rank else 2 * odds[0] - np.median(odds)
        #: A little less than the score itself, which is computed in another order.
        self.reject = float(1 / (1 + np.exp(-bound))) - 1e-6

    def table(self) -> np.ndarray:
        """What each bucket adds to the logits: embedding and softmax weights in one lookup."""
        return (self.E @ self.W).astype(np.float32)

    def predictor(self):
        table, langs, b, t = self.table(), self.langs, self.b, self.temperature

        def predict(text: str | None) -> tuple[str, float]:
            if not has_letters(text):
                return UNKNOWN, 0.0
            z = (table[_grams(text)].mean(axis=0, dtype=np.float64) + b) / t
            p = np.exp(z - z.max())
            p /= p.sum()
            k = int(p.argmax())
            return langs[k], float(p[k])

        return predict


def _fold() -> Column:
    """The remainder by 5 of the CRC-32 of the id's text; null ids count as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5))


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """Fit on at most about ``per_lang`` rows of each language, drawn by a hash of their ids from the labelled folds.

    Only rows with text, a language and a remainder of 1 to 4 are learned from; ``source`` is never read. Without such
    rows the model knows no language and gives ``und`` for all.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_fold() != 0)).select("doc_id", "text", "lang")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()}
    langs = sorted(counts)
    if not langs:
        return LanguageModel([UNKNOWN])
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_lang / counts[lang]))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    sample = sorted(tuple(r) for r in rows.where(drawn).select("doc_id", "text", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(2 * per_lang * len(langs)).collect())
    model = LanguageModel(langs)
    model.fit([t for _, t, _ in sample], [lang for *_, lang in sample])
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (calibrated probability) from each whole text; other columns stay.

    Null text and text without letters give ``und`` with score 0. Columns of those names are replaced.
    """
    kept = [f for f in docs.schema if f.name not in ("lang_pred", "score")]
    names, predict_with = [f.name for f in kept], model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predict_with.predictor()
        for batch in batches:
            text = batch.column(names.index("text"))
            found = [predict(t.as_py()) for t in text]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*names, "lang_pred", "score"]
            )
        release()

    small_batches(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*names).mapInArrow(run, f"{schema}, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from the four folds that are not held out.

    ``accepted`` is whether the score reaches the calibrated bound under which the pipeline rejects a document. Null
    text and text without letters are ``und`` with score 0, not accepted. Each row counts by itself, repeated or
    without ``doc_id``; an empty table gives an empty result.
    """
    docs = load(spark, sf_dir, "documents")
    model = train(docs)
    out = identify(docs.select("doc_id", "text"), model)
    accepted = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= model.reject)
    return out.select("doc_id", (_fold() == 0).alias("held_out"), "lang_pred", "score", accepted.alias("accepted"))
