"""Main text of HTML pages: the maximum-scoring run of tokens, words positive and tags negative, weights learned."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

#: Pages that the weights are fitted on at most; every page is extracted.
SAMPLE = 1500

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|object|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
#: Element names of HTML, by what they do to a text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("nav aside footer form button select menu dialog head".split())
WORDLESS = frozenset("script style noscript template svg iframe object".split())
MAIN = frozenset(("article", "main"))
#: Words in a class, id or role that mark an element as no part of the article, where the learned pages do not show it.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|legal|menu|modal|nav|navbar|navigation|newsletter"
    r"|notices?|popup|promo\w*|related|replies|reply|share|sharing|sidebar|social|sponsor\w*|subscribe|widget|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: Log odds from which on an element's name tells that its words are no part of an article.
UNWANTED = -2.0


def _names(attrs: str) -> list[str]:
    return [f".{n}" for x in _NAMED.findall(attrs) for n in "".join(x).lower().split()]


def _unwanted(tag: str, attrs: str, in_main: bool, weights: dict[str, float]) -> bool:
    """By what HTML says of the tag, by the learned weights of its names, and by ``MARKS`` for names not learned."""
    if tag in BOILERPLATE or tag == "header" and not in_main:
        return True
    if tag in ("html", "body") or not attrs:
        return False
    for name in _names(attrs):
        known = weights.get(name)
        if known <= UNWANTED if known is not None else MARKS.search(name[1:]):
            return True
    return tag not in MAIN and bool(_HIDDEN.search(attrs))


def tokens(page: str, weights: dict[str, float]) -> Iterator[tuple[str, str, bool, int, bool, str]]:
    """``(kind, value, unwanted, main, block, attrs)`` of each tag and text run; ``main`` numbers the outermost main element, 0 outside."""
    stack: list[tuple[str, bool, int]] = []
    depth: Counter[str] = Counter()
    mains = 0
    for m in _TOKEN.finditer(page):
        tag = m.group("tag")
        unwanted, main = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        if m.group("raw"):
            yield "tag", m.group("raw").lower(), True, main, False, ""
            continue
        if not tag:
            text = m.group(0)
            if text[0] != "<" or text == "<":
                yield "text", text, unwanted, main, False, ""
            continue
        tag, attrs = tag.lower(), ""
        if m.group("end"):
            if depth[tag]:
                while True:
                    last = stack.pop()[0]
                    depth[last] -= 1
                    if last == tag:
                        break
        else:
            if tag == "li" and stack and stack[-1][0] == "li" or tag == "p" and stack and stack[-1][0] == "p":
                depth[stack.pop()[0]] -= 1
                unwanted, main = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            if tag in MAIN and not main:
                mains += 1
                main = mains
            attrs = m.group("attrs")
            unwanted = unwanted or _unwanted(tag, attrs, bool(main) and tag not in MAIN, weights)
            if tag not in VOID and not attrs.rstrip().endswith("/") or tag in BLOCKS and tag not in VOID:
                stack.append((tag, unwanted, main))
                depth[tag] += 1
        yield "tag", tag, unwanted, main, tag in BLOCKS, attrs


def learn_weights(pages: list[str]) -> dict[str, float]:
    """Log odds of words, tags, names and places inside against outside the article, over pages that mark exactly one main element.

    What is in the main element, but not in an unwanted part of it, is inside. ``word`` is of each word, a tag of each
    tag, ``.name`` of the words under an element of this class, id or role, ``main`` and ``beside`` of words in and out
    of the main element. Words stay positive and tags negative, whatever the pages: without labelled pages all are at
    their bounds and no name or place has a weight.
    """
    inside, outside, words = Counter(), Counter(), [Counter(), Counter()]
    for page in pages:
        found = list(tokens(page, {}))
        if max((t[3] for t in found), default=0) != 1:
            continue
        named: list[tuple[str, set[str]]] = []  # open elements with names
        for kind, value, unwanted, main, _, attrs in found:
            good = bool(main) and not unwanted
            into = inside if good else outside
            if kind == "text":
                n = len(value.split())
                into["word"] += n
                for name in {x for _, names in named for x in names} | {"main" if main else "beside"}:
                    words[good][name] += n
            else:
                into[value] += 1
                if attrs and value not in VOID and (names := _names(attrs)):
                    named.append((value, set(names)))
                elif not attrs and named and named[-1][0] == value:
                    named.pop()
    a, b = sum(inside.values()) + 1, sum(outside.values()) + 1
    odds = {k: math.log((inside[k] + 0.5) / a) - math.log((outside[k] + 0.5) / b) for k in {*inside, *outside, "word"}}
    weights = {k: max(0.2, w) if k == "word" else min(-0.5, w) for k, w in odds.items()}
    a, b = inside["word"] + 1, outside["word"] + 1
    for k in {*words[0], *words[1]}:
        weights[k] = max(-3.0, min(3.0, math.log((words[1][k] + 0.5) / a) - math.log((words[0][k] + 0.5) / b)))
    return weights


def _passed(token: tuple, main: int) -> bool:
    """Whether a run is extended over a token: a wanted one as far in or out of a main element, or an element without words."""
    kind, value, unwanted, own, *_ = token
    return not unwanted and own == main or kind == "tag" and value in WORDLESS


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The article's blocks, one a line.

    One scan finds the contiguous run of tokens with the greatest sum. A word counts ``word``, and ``main`` or
    ``beside`` where the page marks main elements; words of unwanted elements and all tags count against the run, but for
    those within a main element, which are passed over. So that short blocks at its ends stay, the run is extended both ways up to the next unwanted element or the bound of a
    main element (scripts and the like have no words and do not stop it). The words in it that count for it stay.
    """
    if not page:
        return ""
    found = list(tokens(page, weights))
    marked = any(t[3] for t in found)
    word, other = weights.get("word", 0.2), min((w for k, w in weights.items() if k[0] != "." and k != "beside"), default=-0.5)
    a_word = {True: word + weights.get("main", 0.0) * marked, False: word + weights.get("beside", 0.0) * marked}
    best, begin, total = (0.0, 0, -1), 0, 0.0
    for at, (kind, value, unwanted, main, *_) in enumerate(found):
        if kind == "text":
            score = len(value.split()) * (-word if unwanted else a_word[main > 0])
        else:
            score = max(-3.0, weights.get(value, other))
        if unwanted and main:
            score = 0.0  # what goes from within the main element is no gap in it
        if total <= 0:
            begin, total = at, 0.0
        total += score
        if total > best[0]:
            best = (total, begin, at)
    _, first, last = best
    if last >= 0:
        while first > 0 and _passed(found[first - 1], found[first][3]):
            first -= 1
        while last + 1 < len(found) and _passed(found[last + 1], found[last][3]):
            last += 1
    blocks, now = [], []
    for kind, value, unwanted, main, block, _ in found[first : last + 1]:
        if kind == "text":
            if not unwanted and a_word[main > 0] > 0:
                now.append(value)
        elif block:
            blocks.append("".join(now))
            now = []
        elif value == "br":
            now.append(" ")
    blocks.append("".join(now))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def fitted_weights(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most ``sample`` pages with html, drawn by a hash of their ids."""
    whole = pages.where(F.col("html").isNotNull() & F.col("page_id").isNotNull())
    ids = whole.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = whole.join(F.broadcast(ids), "page_id", "left_semi").select("page_id", "html").dropDuplicates(["page_id"])
    return learn_weights([r[1] for r in rows.collect()])


def main_text(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Add ``text`` to pages with ``html``; null html gives an empty text. A column of that name is replaced."""
    kept = [f for f in pages.schema if f.name != "text"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(h.as_py(), weights) for h in batch.column(names.index("html"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return pages.select(*names).mapInArrow(run, f"{schema}, text string")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages; null and empty html give an empty text. Each row counts by itself, repeated or without ``page_id``."""
    pages = load(spark, sf_dir, "pages")
    out = main_text(pages.select("page_id", "url", "html"), fitted_weights(pages))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
