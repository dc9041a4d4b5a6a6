"""Each stage of the pipeline against brute force on its own input."""

import corpus_pipeline
import numpy as np
import pytest


def test_stages(spark):
    rng = np.random.default_rng(1)
    words = {"en": [f"the{c}nd" for c in "abcdefghijklmnop"], "de": [f"ü{c}ber" for c in "abcdefghijklmnop"]}
    rows = [(i, " ".join(rng.choice(words["en" if i % 2 else "de"], 60)), "en" if i % 2 else "de", "s", 0) for i in range(60)]
    passage = " ".join(rng.choice(words["en"], 55))
    rows += [(60 + i, " ".join(rng.choice(words["en"], 60)) + " " + passage, "en", "s", 0) for i in range(3)]
    rows += [(70, rows[3][1], "en", "s", 0), (71, None, "en", "s", 0), (72, "12 345 !!", "en", "s", 0), (73, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    text = {r[0]: r[1] for r in rows}
    names = docs.columns

    step = [f for _, f in corpus_pipeline.STAGES]
    docs = step[0](spark, docs, "")
    assert docs.columns == names and {r.doc_id for r in docs.collect()} == set(text) - {71, 72, 73}

    docs = step[1](spark, docs, "")
    assert docs.columns == names and {r.doc_id for r in docs.collect()} == set(text) - {70, 71, 72, 73}

    docs = step[2](spark, docs, "")
    got, seen = {r.doc_id: r.text for r in docs.collect()}, set()
    for i in sorted(got):
        b = text[i].encode()
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = bytearray(len(b))
        for k, w in enumerate(own):
            if w in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(own)
        assert got[i] == bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    assert passage in got[60] and passage not in got[61] and docs.columns == names

    packed = step[3](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == set(got)
    by: dict[int, int] = {}
    for r in packed:
        by[r.sequence_id] = by.get(r.sequence_id, 0) + r.length
    assert max(by.values()) <= 1024


def test_near_duplicates_of_missing_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    a, b, c, d, e = (" ".join(rng.choice(words, 40)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (5, b), (5, c), (5, c), (6, c), (7, d), (None, d), (5, e), (None, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), "")
    assert got.columns == docs.columns
    expected = [(None, a), (5, b), (5, c), (7, d), (5, e), (None, None), (8, None)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, expected))


def test_unlabelled_table_fails_loudly(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, f"text {i}", None, "s", 0) for i in range(9)], schema)
    with pytest.raises(ValueError, match="learn a language"):
        corpus_pipeline.identify_language(spark, docs, "")
    assert corpus_pipeline.identify_language(spark, docs.limit(0), "").count() == 0
