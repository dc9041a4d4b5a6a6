"""Quality, collocations and alignment: brute force, held-out accuracy, nulls, empty and long texts, ties, repeats, odd columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from panelspark.llm import alignment, collocations, quality
from panelspark.llm import queries as corpus

SCHEMA = "doc_id long, text string, lang string, score double, predicted int, n_a long, block long, phrase string"


def frame(spark, rows, parts=5):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 0.5, 9, 9, 9, "x") for r in rows], SCHEMA).repartition(parts)


def brute_phrases(rows, support, top=2000):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(low)):
            w = [x for x in re.split("[ \t]", piece) if x]
            lang = "und" if lang is None else lang
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= support}
    out = collections.defaultdict(list)
    for (lang, *w), a in found.items():
        size = len(w)
        if any(len(q) - 1 > size and q[0] == lang and 100 * b >= 80 * a and any(list(q[1 + i : 1 + i + size]) == w for i in range(len(q) - size)) for q, b in found.items()):
            continue
        cuts = [(2000000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, size)]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top])]


def phrase_rows():
    rng = random.Random(4)
    words = ["New", "york", "city", "hall", "the", "of", "ß", "Été", "a\xa0b", "x y", "z"]
    rows = [(0, None, "en"), (1, "", None), (2, " \t ", "en"), (3, "...", "en"), (4, "One", ""), (4, "one one one one", "")]
    for i in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!"]) for _ in range(rng.randint(1, 60)))
        rows.append((i, text, rng.choice(["en", "de", None])))
    rows += [rows[20]] * 4 + [(90, "new york city hall " * 900, "en"), (91, "tie one. tie two. " * 12, "fr")]
    return rows


@pytest.mark.parametrize(("support", "top"), [(7, 2000), (12, 5)])
def test_collocations(spark, support, top):
    rows = phrase_rows()
    got = collocations.collocations(frame(spark, rows), support, top).collect()
    assert sorted(map(tuple, got)) == sorted(brute_phrases(rows, support, top))
    assert {r.lang for r in got} >= {"en", "fr"}


def test_collocations_do_not_depend_on_the_dealing(spark):
    rows = [(i, "alpha beta gamma. " * (i % 3 + 1) + "delta beta", "en") for i in range(40)]
    one = [sorted(map(tuple, collocations.collocations(frame(spark, rows, parts), 30).collect())) for parts in (1, 9, 40)]
    assert one[0] == one[1] == one[2] == sorted(brute_phrases(rows, 30)) and one[0]


def brute_alignment(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert isinstance(a.decoder, decoders.ByteLevel)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    docs, counts = [], collections.Counter()
    for i, text in rows:
        left = [(k, bytes(byte[c] for c in a.id_to_token(k))) for k in a.encode(" " + (text or ""), add_special_tokens=False).ids]
        right = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(text or "")]
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(x for _, x in side) != whole for side in (left, right)):
            docs.append((i, [], [], [], ""))
            continue
        spans = []
        for side in (left, right):
            at, own = 0, []
            for k, x in side:
                own.append((k, at, at := at + len(x)))
            spans.append(own)
        shared = {e for *_, e in spans[0]} & {e for *_, e in spans[1]}
        groups = []
        for own in spans:
            cut = [[]]
            for k, _, e in own:
                cut[-1].append(str(k))
                if e in shared:
                    cut.append([])
            groups.append([",".join(g) for g in cut[:-1]])
        links = [(x, y) for x, s, e in spans[0] for y, p, q in spans[1] if s < q and p < e]
        counts.update(set(links))
        docs.append((i, *spans, links, ";".join(f"{x}|{y}" for x, y in zip(*groups, strict=True))))
    most = collections.defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [(i, len(x), len(y), g.count(";") + 1 if g else 0, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), g) for i, x, y, links, g in docs]


ODD = [None, "", " ", "a", "two words", "  lead and trail  ", "tabs\tand\nlines\r\n\n x", "<|endoftext|> plain <s> </s> <unk> <0x0A>", "mark ▁ in it", "漢字 🙂🙂 é ñ ß", "nul \x00 in it", "1234567890 3.14", "a\xa0b \xa0 c", "  x", "don't we'll", "x" * 500, "«»"]


def test_alignment(spark):
    rng = random.Random(8)
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(None, "two words", "en"), (4, "two words", "en")]
    rows += [(100 + i, " ".join(rng.choices("theory re-align ünder tokenizers, of the 漢字 (x) C++ don't".split(), k=rng.choice([2, 40, 900]))), None) for i in range(30)]
    import public_tokenizers

    paths = [public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    got = alignment.align(frame(spark, rows), *paths, spell=True).collect()
    want = brute_alignment([r[:2] for r in rows])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    by = {r.doc_id: r for r in got}
    assert by[8].n_a == 0 and by[8].groups == "" and by[7].n_a > 0
    digests = {(r.doc_id, r.groups) for r in alignment.align(frame(spark, rows[:9], 2), *paths).collect()}
    assert digests == {(i, hashlib.sha256(by[i].groups.encode()).hexdigest() if by[i].groups else "") for i in range(9)}


def test_alignment_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = corpus.queries()["op13_alignment"](spark, "/root/testdata/sf0.001").collect()
    want = [(*d[:7], hashlib.sha256(d[7].encode()).hexdigest() if d[7] else "") for d in brute_alignment([tuple(d) for d in docs])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = corpus.queries()["op11_quality"](spark, d).collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in label]
    good, bad = ([r.score for r in held if label[r.doc_id] == k] for k in (1, 0))
    assert len(bad) > 10 and np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.96
    assert np.mean([x > y for x in good for y in bad]) > 0.98


def test_quality_scores_against_single_words(spark):
    """The sums over a batch's distinct words are the mean over each text's features one by one."""
    rng = np.random.default_rng(3)
    model = quality.QualityModel()
    model.W, model.temperature, model.prior = rng.normal(size=(quality.DIM, 2)), 1.7, 0.4
    texts = [None, "", " \n", "one", "one one one", "Zwei  Wörter 漢字\tx", "a b " * 4000]
    got = model.scores(pa.array(texts, pa.string()))
    for text, s in zip(texts, got, strict=True):
        at, _, own, pair = quality.features(pa.array([text], pa.string()))
        bag = [g for k in at for g in own[k]] + [p for p in pair if p >= 0]
        odds = np.mean(np.array([model.E[g] for g in bag], float), axis=0) @ (model.W[:, 1] - model.W[:, 0]) / 1.7 if bag else 0.4
        assert s == pytest.approx(1 / (1 + np.exp(-odds)), rel=1e-5)
    again = quality.features(pa.array(["w w", "v v"]))[3]
    assert again[1] == again[3] and again[0] == again[2] == -1


def test_quality_of_few_labels(spark):
    rows = [(i, f"text {i} alike", "en") for i in range(30)] + [(None, "no id", "en"), (5, None, "en")]
    docs = frame(spark, rows, 2)
    for known, expected in (([], 0.5), ([(i, 1) for i in range(30)], 1.0), ([(i, 0) for i in range(30)], 0.0), ([(i, k) for i in range(30) for k in (0, 1)], 0.5)):
        labels = spark.createDataFrame(known, "doc_id long, quality int")
        got = quality.score(docs, quality.train(docs, labels)).collect()
        assert len(got) == 32 and {r.score for r in got} == {expected} and got[0].phrase == "x"


def test_quality_sample_is_bounded(spark):
    rows = [(i, ("good text here " if i % 2 else "bad ### text ### ") * 20, "en") for i in range(400)] + [(1000, "long " * 500_000, "en")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1000, 1)], "doc_id long, quality int")
    model = quality.train(frame(spark, rows), labels, rows=40, total_bytes=9_000, text_bytes=100_000)
    got = {r.doc_id: r.predicted for r in quality.score(frame(spark, rows), model).collect()}
    assert np.mean([got[i] == i % 2 for i in range(400)]) > 0.99


def test_scratch_is_freed(spark):
    """Only the result of an operator stays in the shared folder, and nothing of one that fails."""
    from pathlib import Path

    from panelspark.llm import common, near_dedup

    tables = Path(common.scratch(spark).removeprefix("file:")) / "tables"
    there = lambda: {p.name for p in tables.iterdir()} if tables.exists() else set()
    docs = frame(spark, [(i, f"some words of text {i % 3} " * 9, "en") for i in range(12)], 2)
    for run in (lambda: collocations.collocations(docs, 3), lambda: near_dedup.near_duplicates(docs)):
        before, catalogue = there(), len(spark.catalog.listTables())
        out = run()
        assert len(there() - before) == 1 and len(spark.catalog.listTables()) == catalogue and out.count() > 0
    before = there()
    with pytest.raises(ZeroDivisionError), common.released(spark):
        common.materialise(docs)
        kept = common.materialise(docs, keep=True)
        raise ZeroDivisionError
    assert len(there() - before) == 1 and kept.count() == 12
