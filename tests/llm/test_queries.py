"""The registered corpus queries on small tables with nulls, repeats, odd columns and no rows, against brute force."""

import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from panelspark.llm import queries as corpus
from panelspark.llm import unigram

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, edited string"


def texts(n=60, seed=5):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ka", "mo", "ti", "ré", "su") for b in ("n", "l", "ß", "rt") for c in ("a", "e", "ing", "")]
    out = [None, "", "  ", "one", "Zwei  Wörter", "tab\tline\nend ", "漢字 🙂 x", "a b c d e"]
    while len(out) < n:
        out.append(" ".join(rng.choices(words, k=rng.choice([3, 20, 80, 400]))))
    out += [out[12], out[12], out[13] + " more", "x" * 3000, " ".join(rng.choices(words, k=3000))]
    return out


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A data directory of small tables, and one of empty ones."""
    full, none = (str(tmp_path_factory.mktemp(n)) for n in ("full", "none"))
    rows = [(i, t, "en" if i % 2 else "de", "s", 1, 0.5, "old", "z") for i, t in enumerate(texts())]
    rows += [(3, rows[3][1], "en", "s", 1, 0.5, "old", "z"), (None, "no id here at all", None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    pages = spark.createDataFrame([(i, f"u{i}", f"<article><p>text {i}</p></article>" if i % 3 else None, "clash") for i in range(12)] + [(None, None, "<p>x", None)], "page_id long, url string, html string, text string")
    vectors = spark.createDataFrame([(i, [1.0, float(i % 3), 0.5], i % 2) for i in range(12)] + [(None, [1.0, 0.0, 0.5], 0)], "vec_id long, embedding array<float>, label int")
    labels = spark.createDataFrame([(i, i % 2 if i < 40 else None, 0, "clash") for i in range(50)] + [(3, 0, 0, ""), (None, 1, 0, "")], "doc_id long, quality int, toxic int, text string")
    for d, limit in ((full, None), (none, 0)):
        for name, df in (("documents", docs), ("pages", pages), ("embeddings", vectors), ("labels", labels)):
            (df if limit is None else df.limit(0)).repartition(2).write.parquet(f"{d}/{name}.parquet")
    return full, none, rows


@pytest.mark.parametrize("name", sorted(corpus.queries()))
def test_empty_and_odd_tables(spark, sf, name):
    full, none, rows = sf
    query = corpus.queries()[name]
    assert query(spark, none).count() == 0
    n = query(spark, full).count()
    if name in ("op8_html_extract", "op9_vector_dedup"):
        assert n == 13
    elif name == "op7_warc_fixity":
        assert n == 1  # page 5
    elif name not in ("op3_packing", "op12_collocations"):
        assert n == len(rows)


def test_pipeline_of_no_rows(spark, sf):
    assert corpus_pipeline.run(spark, sf[1]).count() == 0


def test_op2(spark, sf):
    import public_tokenizers

    model = unigram.from_model(public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in corpus.queries()["op2_sentencepiece"](spark, sf[0]).collect()}
    for i, text, *_ in sf[2]:
        marked = unigram.MARK + (text or "").replace(" ", unigram.MARK)
        ids = [k for p in unigram._PART.findall(marked) if p for k in model.viterbi(p)] if text else []
        assert got[i].n_ids == len(ids) and got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert got[i].round_trip and got[i].decoded_crc32 == zlib.crc32((text or "").encode())


def test_op3_gap_to_the_bound(spark, sf):
    got = corpus.queries()["op3_packing"](spark, sf[0]).collect()
    total, used = sum(r.length for r in got), len({r.sequence_id for r in got})
    assert used <= -(-total // 1024) + 1
    ends: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024 and min(r.length for r in got) >= 1


def test_op5(spark, sf):
    got = corpus.queries()["op5_sharding"](spark, sf[0]).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and {r.law for r in got} == {"rows"}
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in sf[2])
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want


def test_op6(spark, sf):
    rows = sorted({(i, t or "") for i, t, *_ in sf[2] if i is not None})
    got = {r.doc_id: r for r in corpus.queries()["op6_fingerprints"](spark, sf[0]).collect() if r.doc_id not in (None, 3)}

    def shingles(t):
        w = [x for x in t.lower().replace("\n", " ").replace("\t", " ").split(" ") if x]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    off = []
    for (i, t), (_, after) in zip(rows, rows[1:]):
        if i in (2, 3):  # the third document is there twice
            continue
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(got[i].fingerprint) in (0, 256)
        for near, other in ((got[i].near_edited, edited), (got[i].near_next, after)):
            a, b = shingles(t), shingles(other)
            off.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.abs(off).max() < 0.13 and abs(np.mean(off)) < 0.02
    same = [got[i].fingerprint for i, t in rows if t == rows[12][1]]
    assert len(same) == 3 and len(set(same)) == 1


def test_op10_held_out(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null").select("doc_id", "lang").collect()}
    got = corpus.queries()["op10_language_id"](spark, "/root/testdata/sf0.001").collect()
    held = [r for r in got if r.held_out and r.doc_id in docs and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert len(held) > 20 and np.mean([docs[r.doc_id] == r.lang_pred for r in held]) > 0.9
    assert np.mean([r.accepted for r in held]) > 0.9


def test_op9_many_lists_and_blocks(spark, monkeypatch):
    """Planted pairs among many vectors, with lists and blocks so small that both split: every eighth queried against all."""
    from panelspark.llm import vector_dedup

    monkeypatch.setattr(vector_dedup, "BLOCK", 64)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 16))
    x[2000:] = x[:2000] + 0.22 * rng.normal(size=(2000, 16)) * rng.random((2000, 1)) * 2
    x[100:160] = x[0] + 0.1 * rng.normal(size=(60, 16))
    df = spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vector_dedup.vector_links(df, n_lists=32).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    asked = np.arange(0, 4000, 8)
    true = (u[asked] @ u.T >= 0.93).sum(axis=1) - 1
    assert true.sum() > 500 and [got[i] for i in asked] == true.tolist()


@pytest.mark.parametrize("block", [200, 16_384])
def test_op9_sends_a_vector_once_to_a_block_of_lists(spark, monkeypatch, block):
    """rows that are shuffled are those of a label times its blocks, however many lists are probed; also with vectors of one direction."""
    from panelspark.llm import vector_dedup
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    plain, sent = PandasCogroupedOps.applyInArrow, []

    def counted(self, *args):
        sent.append([side._df.count() for side in (self._gd1, self._gd2)])
        return plain(self, *args)

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", counted)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 24))
    x[500:560] = x[0] * np.arange(1, 61)[:, None]
    x[600:640] = x[1] + 0.1 * rng.normal(size=(40, 24))
    df = spark.createDataFrame([(i, [float(v) for v in row], i % 3 % 2) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vector_dedup.vector_links(df, n_lists=24).collect()}
    blocks = {0: -(-600 // block), 1: -(-300 // block)}
    assert len(sent) == 1 and all(n <= 600 * blocks[0] + 300 * blocks[1] for n in sent[0])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    label = np.arange(900) % 3 % 2
    true = ((u @ u.T >= 0.93) & (label[:, None] == label)).sum(axis=1) - 1
    assert true.sum() > 1000 and [got[i] for i in range(900)] == true.tolist()
