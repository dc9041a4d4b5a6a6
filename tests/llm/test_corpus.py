"""The corpus operators against brute force on small documents with nulls, empties, copies, long texts and odd columns."""

import bisect
import hashlib
import random
import zlib

import numpy as np
import pytest
from panelspark.llm import fingerprints, fixity, html_extract, language_id, near_dedup, packing, sharding, suffix_dedup, unigram, vector_dedup

WORDS = [f"w{i}x{'abcdefg'[i % 7]}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, batch int, keys string"


def documents():
    rng = random.Random(3)
    texts = [None, "", " \t\n ", "One", "one two", "Ünï 漢字 🙂 é", "12345 !!"]
    for _ in range(25):
        texts.append(" ".join(rng.choices(WORDS, k=rng.randint(5, 120))))
    base = rng.choices(WORDS, k=150)
    for i in range(10):  # near copies, one word changed
        own = list(base)
        own[7 * i] = "changed"
        texts.append(" ".join(own))
    texts += [texts[10]] * 4 + [" ".join(rng.choices(WORDS, k=9000))]
    passage = " ".join(rng.choices(WORDS, k=30))
    texts += [f"{rng.choice(WORDS)} {passage} {rng.choice(WORDS)} é" for _ in range(5)]
    return [(i, t, "en" if i % 2 else None, "s", None if t is None else len(t), 9, 9, "k") for i, t in enumerate(texts)]


DOCS = documents()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(links, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, width, percent):
    sets = {d[0]: shingles(d[1], width) for d in DOCS}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    expected = components(links, sets)
    got = near_dedup.near_duplicates(docs, width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), expected[i]) for i, s in sets.items()}
    assert len(links) > 40


def test_near_duplicates_of_one_core(spark):
    """A group of copies of one text, each changed in its own words, some over and some under the bound, and partial links."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(160)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        own = list(base)
        for at in rng.sample(range(160), rng.randint(0, 9)):
            own[at] = f"own{i}x{at}" if rng.random() < 0.8 else rng.choice(base)
        del own[: rng.randint(0, 6)]
        rows.append((i, " ".join(own)))
    rows += [(120, rows[3][1]), (3, rows[3][1]), (None, rows[3][1]), (121, None), (122, " ")]
    sets = {i: shingles(t, 3) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    expected = components(links, sets)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {i: (len(s), expected[i]) for i, s in sets.items()}
    assert [r.component_id for r in got if r.doc_id is None] == [None] and len(got) == len(rows)
    assert len(set(expected.values())) > 20 and len(links) > 300


def test_signature_recall():
    """Of pairs right at the bound almost none differs in more values than is looked at or shares no key."""
    rng = np.random.default_rng(4)
    for percent in (80, 85):
        kind, met = near_dedup.scheme(percent), 0
        for _ in range(300):
            common = rng.integers(0, 2**63, 4 * percent, dtype=np.uint64)
            x, y = (np.concatenate([common, rng.integers(0, 2**63, 2 * (100 - percent), dtype=np.uint64)]) for _ in range(2))
            a, b = near_dedup._minhashes(np.unique(x), kind.size), near_dedup._minhashes(np.unique(y), kind.size)
            met += (a != b).sum() <= kind.distance and bool(set(near_dedup._keys(a[None], kind)[0]) & set(near_dedup._keys(b[None], kind)[0]))
        assert met == 300


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 95])
def test_index_at_the_exact_distance(percent):
    """Any two signatures with exactly as many different values as are looked at share a key, also where the errors are spread evenly."""
    kind, rng = near_dedup.scheme(percent), np.random.default_rng(6)
    assert kind.distance <= 2 * kind.chunks - 1
    for n in range(200):
        a = rng.integers(0, 1 << 16, kind.size).astype(np.uint64)
        b, order = a.copy(), rng.permutation(kind.size) if n % 2 else np.arange(kind.size).reshape(kind.chunks, kind.values).T.ravel()
        b[order[: kind.distance]] += np.uint64(1 << 16)
        assert (a != b).sum() == kind.distance and set(near_dedup._keys(a[None], kind)[0]) & set(near_dedup._keys(b[None], kind)[0])


def test_suffix_dedup(docs):
    seen, expected = set(), {}
    for i, text, *_ in DOCS:
        b = (text or "").encode()
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = bytearray(len(b))
        for k, w in enumerate(own):
            if w in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(own)
        expected[i] = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore") if text is not None else None
    got = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == expected


def test_suffix_dedup_large_anchor(docs, monkeypatch):
    plain = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(docs).collect()}
    monkeypatch.setattr(suffix_dedup, "LARGE", 1)
    assert {r.doc_id: r.text for r in suffix_dedup.remove_repeats(docs).collect()} == plain


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, 64).collect()
    for i, text, *_ in DOCS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces[:-1]]))
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        assert sum(p.length for p in pieces) == len(ids)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_all_pieces(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(40)}
    plan = packing.best_plan(histogram, 100)
    got = {}
    for lengths, count in plan.runs:
        assert sum(lengths) <= 100
        for n in lengths:
            got[n] = got.get(n, 0) + count
    assert got == histogram
    rooms = []  # plain best fit, one piece at a time
    for length in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        at = bisect.bisect_left(rooms, length)
        bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else 100) - length)
    assert plan.sequences() <= len(rooms) + 1


def test_tokenizer_words_equal_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    store, plain = packing.IdStore(path), Tokenizer.from_file(path)
    for t in ["a  b", " lead", "tail ", "x \n y", "it's  a\ttab", "  ", " ", "<|endoftext|> a", "a <|endoftext|>b", "  x", "a\x1c b", "你 好", "a 　b"]:
        assert store.ids(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_sharding(docs):
    rows = docs.select("doc_id", "text")
    got = sharding.shuffle_to_shards(rows, ["doc_id"], 4).collect()
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(4)]
    assert [s == list(range(len(s))) for s in sizes] == [True] * 4
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1
    matrix = sharding.communication_matrix([5, 0, 7], [6, 6], 1)
    assert [sum(r) for r in matrix] == [5, 0, 7] and [sum(c) for c in zip(*matrix)] == [6, 6]


def test_hypergeometric_draws():
    from math import comb

    rng = np.random.default_rng(1)
    for good, bad, n in [(5, 7, 6), (30, 10, 12), (3, 40, 20), (0, 5, 3), (4, 0, 2)]:
        got = np.bincount([sharding.hypergeometric(rng, good, bad, n) for _ in range(4000)], minlength=n + 1) / 4000
        true = np.array([comb(good, k) * comb(bad, n - k) / comb(good + bad, n) for k in range(n + 1)])
        assert np.abs(got - true).max() < 0.04
    big = np.array([sharding.hypergeometric(rng, 4 * 10**11, 6 * 10**11, 10**10) for _ in range(2000)], float)
    sd = (10**10 * 0.4 * 0.6 * 0.99) ** 0.5
    assert abs(big.mean() - 4 * 10**9) < 5 * sd / 2000**0.5 and abs(big.std() / sd - 1) < 0.08
    assert abs(sharding._log_ratio(5000, 4000) - sum(np.log(np.arange(4001, 5001)))) < 1e-6


def test_shuffle_is_uniform(spark):
    """Each row is as likely in each shard: over many seeds, counts of rows by shard stay near their mean."""
    rows = spark.range(24).selectExpr("id AS doc_id", "'x' AS text", "id AS shard")
    counts = np.zeros((24, 4))
    for seed in range(40):
        for r in sharding.shuffle_to_shards(rows, ["doc_id"], 4, seed=seed, n_blocks=3).collect():
            counts[r.doc_id, r.shard] += 1
    assert (counts.sum(axis=1) == 40).all() and ((counts - 10) ** 2 / 10).sum() < 130  # 69 degrees of freedom


def test_fingerprints(spark, docs):
    from pyspark.sql import functions as F

    rows = fingerprints.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", {"sig": fingerprints.signature(F.col("text"))})
    rows = rows.select("*", fingerprints.likeness(F.col("sig"), F.col("next_sig")).alias("near")).collect()
    by = {r.doc_id: r for r in rows}
    n = len(DOCS)
    for i, t, *_ in DOCS:
        assert by[i].next_text == (DOCS[(i + 1) % n][1] or "")
        other = DOCS[(i + 1) % n][1]
        a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((x or "").lower().split() for x in (t, other)))
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(by[i].near - true) < 0.2
    assert by[32].near > 0.5  # near copies


def test_language(docs):
    rng = np.random.default_rng(0)
    make = lambda words: " ".join(rng.choice(words, 30))
    texts, langs = zip(*[(make(["the", "and", "house"]), "en") for _ in range(40)], *[(make(["der", "und", "häuser"]), "de") for _ in range(40)])
    model = language_id.LanguageModel(["de", "en"])
    model.fit(list(texts), list(langs))
    predict = model.predictor()
    assert predict("the house and the house")[0] == "en" and predict("und der häuser")[0] == "de"
    assert predict(None) == ("und", 0.0) == predict("12 !!") == predict("")
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 for r in got)


def test_language_learns_all_of_long_texts():
    text = " ".join(f"{a}{b}{c}q" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop" for c in "abcdefghijklmnop")
    model, seen = language_id.LanguageModel(["de", "en"]), language_id._grams(text)
    before = model.E.copy()
    model.fit([text, "der und"], ["en", "de"])
    moved = (model.E != before).any(axis=1)
    assert moved[np.unique(seen)].mean() > 0.99


def test_language_rejection():
    rng = np.random.default_rng(0)
    vocabulary = {"en": ["the", "and", "house", "water", "north", "with"], "de": ["der", "und", "häuser", "wasser", "norden", "mit"]}
    make = lambda lang: " ".join(rng.choice(vocabulary[lang], rng.integers(20, 60)))
    langs = [lang for lang in vocabulary for _ in range(300)]
    model = language_id.LanguageModel(sorted(vocabulary))
    model.fit([make(lang) for lang in langs], langs)
    predict = model.predictor()
    own = [predict(make(lang))[1] >= model.reject for lang in vocabulary for _ in range(200)]
    assert sum(own) >= 0.97 * len(own)
    other = " ".join(["het", "en", "huizen", "water", "noorden", "met"] * 6)  # unlearned, with n-grams of both
    assert predict(other)[1] < model.reject
    few = language_id.LanguageModel(sorted(vocabulary))
    few.fit([make(lang) for lang in langs[::20]], langs[::20])
    own = [few.predictor()(make(lang))[1] >= few.reject for lang in vocabulary for _ in range(50)]
    assert few.reject > 0 and sum(own) >= 0.97 * len(own)


def test_sentencepiece():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁ab", "bab", *[f"<0x{i:02X}>" for i in range(256)]]
    scores = [0, -2.0, -1.5, -1.5, -2.5, -3.0, -2.2, *[0.0] * 256]
    model = unigram.Unigram(pieces, scores, list(range(7, 263)), 0, frozenset([0, *range(7, 263)]))

    def best(s):
        top = {0: (0.0, [])}
        for j in range(1, len(s) + 1):
            ways = [(top[i][0] + scores[k], top[i][1] + [k]) for i in range(j) for k in range(1, 7) if i in top and s[i:j] == pieces[k]]
            if ways:
                top[j] = max(ways, key=lambda w: w[0])
        return top[len(s)][0]

    rng = random.Random(1)
    for _ in range(50):
        s = "▁" + "".join(rng.choices("ab", k=rng.randint(1, 12)))
        assert sum(scores[k] for k in model.viterbi(s)) == pytest.approx(best(s))
    encoder = unigram.Encoder(model)
    for t in ["ab bab", "", "é🙂 a", "  a  b ", "a\nb"]:
        assert model.decode(encoder.encode(t).tolist()) == t


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"u{i}", None if i == 3 else f"<p>{i}</p>") for i in range(2300)] + [(None, None, None)], "page_id long, url string, html string")
    a = fixity.warc_records(pages)
    b = fixity.warc_records(pages.replace("u1234", "changed", "url"))
    assert [(r.volume, r.at) for r in fixity.audit(a, b).collect()] == [(1, 234)]
    assert fixity.audit(a, a).count() == 0
    more = fixity.warc_records(pages.unionByName(spark.createDataFrame([(2400, "only there", "x"), (None, "nor id", "y")], pages.schema)))
    found = fixity.audit(a, more).collect()
    assert {(r.page_id, r.primary_sha256 is None) for r in found} == {(2400, True), (None, True)}


def test_html():
    page = """<html><head><title>T</title></head><body><header class="site">Menu words here</header><nav><a>Home</a></nav><div class="cookie-notice">We use cookies</div>
    <article><header><h1>The  head&amp;line</h1></header><p>First <b>bold</b>&nbsp;text<p>Second &lt;para<script>x</script></p><aside>side</aside><form>name</form>
    <div id="comments"><p>reader says</p></div><p>End.</p></article><footer>foot</footer>"""
    weights = html_extract.learn_weights([page] * 3)
    assert html_extract.extract(page, weights) == "The head&line\nFirst bold text\nSecond <para\nEnd."
    plain = "<body><nav><li>one</li><li>two</li></nav><div><p>" + "word " * 40 + "</p><p>more " * 5 + "</p></div><div class=footer>foot</div></body>"
    assert html_extract.extract(plain, weights).startswith("word word") and "foot" not in html_extract.extract(plain, weights)
    assert html_extract.extract(None, weights) == "" == html_extract.extract("<p></p>", weights)


def web_pages(n, seed):
    """Pages with an article among menus, adverts, notices and comments, and the text that should come out."""
    rng = random.Random(seed)
    say = lambda a, b: " ".join(rng.choices(WORDS, k=rng.randint(a, b)))
    for _ in range(n):
        blocks = [say(1, 8), *(say(3, 60) for _ in range(rng.randint(1, 8)))]
        inner = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" if rng.random() < 0.7 else f"<div class=part><p>{b}</p></div>" for b in blocks[1:])
        extra = f"<div class='zqx'><p>{say(3, 12)}</p></div>"  # a name that only labelled pages tell of
        links = "".join(f"<li><a href=x>{say(1, 2)}</a></li>" for _ in range(8))
        page = f"<html><head><title>{say(3, 5)}</title></head><body><nav><ul>{links}</ul></nav>{extra}<article>{inner}</article>{extra}<footer>{say(5, 20)}</footer></body></html>"
        yield page, "\n".join(blocks)


def overlap(got, want):
    from collections import Counter

    a, b = Counter(got.split()), Counter(want.split())
    return (a & b).total(), a.total(), b.total()


def test_html_held_out():
    """Learned on labelled pages; on others without their article tag, precision and recall of words, better than unlearned."""
    weights = html_extract.learn_weights([p for p, _ in web_pages(150, 1)])
    scores = []
    for w in (weights, {}):
        sums = np.zeros(3)
        for page, want in web_pages(150, 2):
            sums += overlap(html_extract.extract(page.replace("article>", "div>"), w), want)
        scores.append((sums[0] / sums[1], sums[0] / sums[2]))
    (precision, recall), (before, _) = scores
    assert precision > 0.99 and recall > 0.99 and before < precision - 0.05
    assert all(html_extract.extract(page, weights) == want for page, want in web_pages(150, 3))
    deep = "<div>" * 20000 + "word " * 50 + "</span>" * 20000
    assert html_extract.extract(deep, weights) == ("word " * 50).strip()


def test_html_short_blocks_without_main_element():
    weights = {"word": 0.9, "div": -2.0, "p": -2.0}
    page = """<html><head><title>T</title></head><body><nav><a>Home</a> and a menu</nav><div>Title</div><div><p>By me</p></div>
    <script>x = 1</script><div>""" + "word " * 30 + """</div><div class="share">share this</div><div>between</div><div>""" + "more " * 30 + """</div>
    <style>y</style><div><div><p>The end.</p></div></div><footer>foot</footer><div>after</div></body></html>"""
    words, more = ("word " * 30).strip(), ("more " * 30).strip()
    assert html_extract.extract(page, weights) == "\n".join(["Title", "By me", words, "between", more, "The end."])
    assert html_extract.extract("<div>a</div>" * 2, weights) == "a\na"


def test_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 20))
    x[50:120] = x[0] + 0.15 * rng.normal(size=(70, 20))
    x[120:140] = x[7]
    x[140] = 0
    rows = [(i, [float(v) for v in row], None if i == 200 else i % 2) for i, row in enumerate(x)]
    rows[141] = (141, None, 1)
    rows[142] = (142, [float("nan")] * 20, 0)
    rows[143] = (143, [], 0)
    ok = np.array([i not in (140, 141, 142, 143, 200) for i in range(300)])
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    same = np.arange(300)[:, None] % 2 == np.arange(300) % 2
    link = (u @ u.T >= 0.93) & same & ok[:, None] & ok & ~np.eye(300, dtype=bool)
    expected = components(zip(*np.nonzero(link), strict=True), range(300))
    got = vector_dedup.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(link[i].sum()), expected[i]) for i in range(300)}


def test_empty_tables(spark, empty):
    import public_tokenizers

    assert near_dedup.near_duplicates(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert packing.pack_documents(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert sharding.shuffle_to_shards(empty, ["doc_id"]).count() == 0
    assert language_id.identify(empty, language_id.train(empty)).count() == 0
    assert vector_dedup.vector_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert hashlib.sha256(b"").hexdigest()
