"""Operator 5, HTML extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, less so in links and, on pages that mark their content, outside of it; tags score negative, by weights
learnt from labelled pages: how much more often a tag stands outside the labelled content than inside. Elements that are boilerplate by name or by the evidence of
their class, id and role cost a fixed amount each and none of their words count. One linear scan finds the contiguous region with the highest sum; its blocks,
less those elements, are the text.

The evidence of a class is the sum over its tokens: a fixed start by what the token's head word says, and what labelled pages say, the log-odds of standing inside
their content. Labelled pages are those that mark their content themselves, with one ``article`` or ``main`` element; all weights are fitted
on a bounded sample of them.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pages that the weights are fitted on, about, at most; occurrences from which a class token's weight is learnt.
SAMPLE, SEEN = 2000, 20
#: Fixed values, element names of HTML.
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button select option input label fieldset head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTENT = frozenset(("article", "main"))
#: Elements whose open one ends at the next of its kind.
CLOSERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Fixed words: heads of class names that tell boilerplate, that may, and that tell content; words that are no head; those that stand before one written together with it;
#: words that make a class speak of another element.
TELLING = frozenset("ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promotion sidebar comment comments respond disqus reply replies cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social widget widgets toolbar pagination pager skip complementary contentinfo copyright disclaimer hidden".split())
DOUBTFUL = frozenset("header related recommended recommendations recent popular trending tag tags search legal meta form aside".split())
SPEAKING = frozenset("article post entry content story main text prose".split())
GENERIC = frozenset("list item items slot bar buttons button box container wrapper wrap links link icons icon block area section inner outer left right top bottom unit zone label message group row column col panel holder body thread form toggle posts articles stories primary secondary fixed sticky mobile desktop fluid default".split())
BEFORE = frozenset("site page top main global left right bottom sub side foot head post".split())
ELSEWHERE = frozenset("with has no without is show hide js".split())
TELLS, DOUBTS, SPEAKS, FROM = -3.0, -1.5, 1.5, -1.5
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
START_WEIGHTS = {"p": -0.05, "br": -0.05, "h1": -0.1, "h2": -0.1, "h3": -0.1, "article": -0.1, "main": -0.1, "b": -0.05, "i": -0.05, "em": -0.05, "strong": -0.05, "u": -0.05, "span": -0.05, "sup": -0.05, "sub": -0.05, "code": -0.1, "a": -0.3, "img": -0.3, "li": -0.3, "ul": -0.3, "ol": -0.3, "h4": -0.1, "blockquote": -0.1, "pre": -0.1, "section": -0.3}
#: Scores of other tags, of an element that is left out, of a word in a link, and of one outside of marked content.
OTHER, SKIPPED, LINKED, OUTSIDE = -0.5, -4.0, 0.3, -0.5

Token = tuple[str, str, bool, bool, bool, tuple[str, ...]]  # tag name or "", text, left out, in labelled content, in a link, class tokens


@cache
def _attributes(attributes: str) -> tuple[tuple[str, ...], bool]:
    """(tokens of class, id and role, whether the element is hidden) of a tag's attributes; the first of equal names counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    names = tuple(x for c in ("class", "id", "role") for x in found.get(c, "").split())
    return names, "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(found.get("style", "")))


@cache
def prior(token: str) -> float:
    """What a class token says by itself: its head is the last word that is no generic noun, and no word for text behind a telling one (``comment-text``)."""
    words = [w for w in re.split(r"[-_:]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", token).lower()) if w]
    if not words or len(words) > 1 and words[0] in ELSEWHERE:
        return 0.0
    while len(words) > 1 and (words[-1] in GENERIC or words[-1].isdigit() or words[-1] in SPEAKING and words[-2] in TELLING):
        words.pop()
    last = words[-1]
    if last not in TELLING | DOUBTFUL:  # written together: commentlist, topnav
        last = max((t for t in TELLING | DOUBTFUL if last.startswith(t) and last[len(t) :] in GENERIC or last.endswith(t) and last[: -len(t)] in BEFORE), key=lambda t: (len(t), t), default=last)
    own = TELLS if last in TELLING else DOUBTS if last in DOUBTFUL else 0.0
    return own + SPEAKS * any(w in SPEAKING for w in words)


def evidence(names: tuple[str, ...], learnt: dict[str, float]) -> float:
    return sum(prior(x) + learnt.get(f".{x}", 0.0) for x in names)


def tokens(page: str, weights: dict[str, float]) -> list[Token]:
    """Tags and text runs in page order. A tag's name has a leading slash if it closes; raw elements give their tags only.

    An element left out by the evidence of its class counts after all if the page's only article or main stands in it.
    """
    found: list[tuple] = []
    stack: list[tuple[str, int]] = []  # name, number of the element if it is left out
    opened: Counter[str] = Counter()
    out: tuple[int, ...] = ()  # the elements left out that are open
    by_class: set[int] = set()
    kept: set[int] = set()
    labels = [0, {x: len(re.findall(rf"<{x}[\s>]", page, re.I)) for x in CONTENT}]
    at = links = 0

    def pop() -> str:
        nonlocal out, links
        name, number = stack.pop()
        opened[name] -= 1
        if number:
            out = out[:-1]
        labels[0] -= name in CONTENT
        links -= name == "a"
        return name

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        if not m[2]:
            if not m[0].startswith(("<!", "<?")):
                found.append(("", m[0], out, labels[0] > 0, links > 0, ()))
            continue
        name = m[2].lower()
        if m[1]:
            before = out
            if opened[name]:
                while pop() != name:
                    pass
            found.append(("/" + name, "", before, labels[0] > 0, links > 0, ()))
            continue
        attributes = m[3]
        if name in BLOCK:  # a paragraph ends where a block starts
            while stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSERS.get(name, ())):
                pop()
        names, hidden = _attributes(attributes) if "=" in attributes or "hidden" in attributes.lower() else ((), False)
        named = name in BOILERPLATE and not (name == "header" and labels[0] and not out)
        bad = named or name not in ("html", "body") and (hidden or bool(names) and evidence(names, weights) <= FROM)
        if name in CONTENT and not bad and labels[1][name] == 1:
            kept.update(x for x in out if x in by_class)
        number = len(found) + 1 if bad else 0
        if bad and not named and not hidden:
            by_class.add(number)
        found.append((name, "", (*out, number) if bad else out, labels[0] > 0, links > 0, names))
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
        stack.append((name, number))
        opened[name] += 1
        if bad:
            out = (*out, number)
        labels[0] += name in CONTENT and not bad
        if name in CONTENT and bad:
            labels[0] += 1  # taken off again when it closes
        links += name == "a"
    return [(name, text, any(x not in kept for x in gone), inside, link, names) for name, text, gone, inside, link, names in found]


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the highest sum: one scan. Of equal sums the first, the shortest; none if no score is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best + 1e-9:
            best, region = total, (start, i + 1)
    return region


def extract(page: str | None, weights: dict[str, float]) -> str:
    """Main text: character references decoded, white space inside a block one space, blocks joined by an empty line."""
    found = tokens(page or "", weights)
    marked = any(inside and not name and not skipped for name, _, skipped, inside, _, _ in found)
    scores, before = [], False
    for name, text, skipped, inside, link, _ in found:
        if skipped:
            scores.append(0.0 if before else SKIPPED)
        elif name:
            scores.append(weights.get(name.lstrip("/"), OTHER))
        else:
            scores.append((OUTSIDE if marked and not inside else LINKED if link else 1.0) * len(html.unescape(text).split()))
        before = skipped
    start, end = best_region(scores)
    blocks, run = [], []

    def close() -> None:
        if block := " ".join(html.unescape("".join(run)).split()):
            blocks.append(block)
        run.clear()

    for name, text, skipped, *_ in found[start:end]:
        if not name:
            if not skipped:
                run.append(text)
        elif name.lstrip("/") in BLOCK:
            close()
        elif name.lstrip("/") == "br":
            run.append(" ")
    close()
    return "\n\n".join(blocks)


def learn(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights by tag name and, with a dot in front, by class token: the log-odds of standing inside the labelled content.

    A tag's is never above a small negative number; a token's, from SEEN occurrences on, goes from -3 to 1. Tags in elements that are left out anyway say nothing.
    Fitted on about ``sample`` labelled pages, chosen by the hash of their html; without any, the starting weights hold.
    """
    labelled = pages.select("html").where(F.lower("html").rlike(r"<(article|main)[\s>]"))
    n = labelled.count()
    chosen = labelled.where(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < max(1, int(min(1.0, sample / max(n, 1)) * (1 << 20)))) if n > sample else labelled

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[tuple[str, bool]] = Counter()
        for b in batches:
            for page in b.column("html").to_pylist():
                for name, _, skipped, inside, _, names in tokens(page, {}):
                    if name and not skipped:
                        sums[name.lstrip("/") if name.lstrip("/") in BLOCK | VOID | RAW | START_WEIGHTS.keys() else "*", inside] += 1
                    for x in names:
                        sums[f".{x}", inside] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.bool_()), pa.array(list(sums.values()), pa.int64())], ["tag", "inside", "n"])

    rows = chosen.mapInArrow(count, "tag string, inside boolean, n long").groupBy("tag").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"), F.sum("n").alias("n")).where(F.expr(f"not startswith(tag, '.') or n >= {SEEN}")).collect()
    weights = dict(START_WEIGHTS)
    for r in rows:
        odds = math.log((r.inside + 1) / (r.n - r.inside + 1))
        if r.tag.startswith("."):
            weights[r.tag] = min(1.0, max(-3.0, odds))
        elif r.tag not in CONTENT and r.tag not in ("html", "body"):
            weights[r.tag] = min(-0.05, max(-4.0, odds))
    return weights


EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extracted(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    Null or empty html gives an empty text; null ids and urls and repeated rows stay; an empty table gives an empty table; other
    columns are not read, whatever their names. Pages are taken whole, at any length.
    """
    weights = learn(pages, sample)

    def run(row: dict) -> Iterator[dict]:
        text = extract(row["html"], weights)
        yield {"page_id": row["page_id"], "url": row["url"], "text": text, "n_chars": len(text)}

    return pages.select("page_id", "url", "html").mapInArrow(common.over_rows(run, EXTRACTED), "page_id long, url string, text string, n_chars long")
