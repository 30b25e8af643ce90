"""HTML extraction by maximum-scoring subsequence.

A page is a run of words and tags. Words score positive and tags negative, by weights learned
from labelled pages (those with one <article>); words in elements that hold no content score
negative. What holds none is told by the kind of element, or by the words of its class and id, whose
weights are learned too (words of MARKED begin as if seen a few times outside articles). A wrapper is never left
out for its name: what holds most of the page's words and its only article, or, on a page without one, what holds a
block of content for most of its words and leaves hardly any words outside that are in no such element, however
long it is. Where a page marks an article, tags in it cost nothing and words outside it score negative
too. One linear scan finds the contiguous run with the highest sum.

Cases: null and empty pages have an empty text; without labelled pages plain weights hold; broken
markup (open elements, stray ends, a script that never ends) is read to the end of the page, in time
linear in its length; from a tag whose quotes leave it open to the end on, quotes mean nothing;
repeated rows are extracted alike; columns of other names are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import hash_below

#: Labelled pages to learn from, about: drawn by hash of url, whole pages.
TRAIN_PAGES = 2000
#: Tags and words of classes have a weight of their own if the labelled pages hold so many (words under a class); other tags share one.
SEEN = 5
RAREST, MILDEST = -4.0, -0.02

# Names in HTML, and words in classes and ids.
SKIPPED = frozenset("nav footer aside form head dialog".split())
NO_TEXT = frozenset("button select textarea iframe noscript svg template object canvas".split())
CONTAINERS = frozenset("article aside details div dl fieldset figure form header footer main nav ol section span table ul".split())
BLOCK_OF_CONTENT = frozenset("article div main section table td ul ol dl".split())
RAW = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
MARKED = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu sidebar footer header cookie cookies"
    " consent notice newsletter subscribe popup modal overlay comment comments discussion share sharing social related recommended breadcrumb"
    " breadcrumbs pagination pager widget login signup search masthead toolbar".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in RAW}
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PART = re.compile(r"[a-z]+", re.IGNORECASE)
#: An element is left out if the words of its class weigh this little on average, one of a paragraph's kind if they weigh less still.
LEFT_OUT, LEFT_OUT_BLOCK = -0.75, -1.5
#: Words outside a wrapper, at most, that are in no element left out: those of a page's own frame. Of an element that
#: has another name too, so many for each two words in it.
FRAME, FRAME_SHARE = 20, 0.5
#: Words (of a thousand outside articles) that those of MARKED count as seen with.
PRIOR = 10.0
#: Words of a class that say nothing inside an article.
IN_ARTICLE = frozenset(["header"])


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, name or "" for a comment, attributes) of each piece of markup."""
    at, last, quotes = 0, page.rfind(">"), True
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, False, "", ""
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1 or len(page)
            yield at, end, False, "", ""
        else:
            closes = page.startswith("</", at)
            name = _NAME.match(page, at + 1 + closes)
            if not name or at > last:
                at += 1
                continue
            stop = name.end()
            while quotes and (m := _STOP.search(page, stop)) and m[0] != ">":
                stop = page.find(m[0], m.end()) + 1
                if not stop:
                    m = None
                    break
            if quotes and not m:
                quotes = False
            end = m.end() if quotes else page.find(">", name.end()) + 1
            yield at, end, closes, name[0].lower(), page[name.end() : end - 1]
            if name[0].lower() in RAW and not closes:
                close = _RAW_END[name[0].lower()].search(page, end)
                end = close.end() if close else len(page)
                yield at, end, False, "", ""
        at = end


class Element(NamedTuple):
    parent: int
    tag: str
    names: tuple[tuple[str, ...], ...]  # the parts of each word of its class and id
    named: bool  # by role or attribute, as no content


def _element(parent: int, tag: str, attributes: str) -> Element:
    names, named = [], False
    if "=" in attributes:
        for kind, *values in _ATTRIBUTE.findall(attributes):
            if kind.lower() == "role":
                named = named or "".join(values).strip().lower() in ROLES
            else:
                names += [parts for w in "".join(values).split() if (parts := tuple(p.lower() for p in _PART.findall(w)))]
    if "hidden" in attributes:
        named = named or bool(re.search(r"(?<![\w-])hidden(?![\w-])", re.sub(r"=\s*(\"[^\"]*\"|'[^']*')", "", attributes)))
    return Element(parent, tag, tuple(names), named)


def parse(page: str) -> tuple[list[tuple[str, str, int]], list[Element]]:
    """The page's tokens (tag or "", text, number of the element they are in) and its elements, the page itself first."""
    tokens, elements, stack, open_ = [], [Element(-1, "", (), False)], [0], Counter()
    at = 0
    for start, end, closes, tag, attributes in tags(page):
        if start > at:
            tokens.append(("", page[at:start], stack[-1]))
        at = max(at, end)
        if not tag or tag in RAW:
            continue
        if not closes:
            if tag in ("p", "li", "td", "tr", "dd", "dt", "option") and elements[stack[-1]].tag == tag:
                open_[elements[stack.pop()].tag] -= 1
            inside = stack[-1]
            if tag not in VOID and not attributes.endswith("/"):
                elements.append(_element(stack[-1], tag, attributes))
                inside = len(elements) - 1
                stack.append(inside)
                open_[tag] += 1
        else:
            while open_[tag]:
                left = elements[stack.pop()].tag
                open_[left] -= 1
                if left == tag:
                    break
            inside = stack[-1]
        tokens.append((("/" if closes else "") + tag, "", inside))
    if at < len(page):
        tokens.append(("", page[at:], stack[-1]))
    return tokens, elements


class Weights:
    """What a word adds, what each tag takes, and what each word of a class says about the words in its element."""

    def __init__(self, counts: pd.DataFrame):
        rows = {t: (i, o) for t, i, o in zip(counts["tag"], counts["inside"], counts["outside"], strict=True)}
        names = {t[1:]: rows.pop(t) for t in list(rows) if t.startswith(".")}
        n_in, n_out = (sum(r[k] for r in rows.values()) + len(rows) + 1 for k in (0, 1))
        ratio = {t: float(np.log((i + 1) / n_in) - np.log((o + 1) / n_out)) for t, (i, o) in rows.items()}
        self.word = min(2.0, max(0.2, ratio.pop("", 1.0)))
        self.tags = {t: min(MILDEST, max(RAREST, r)) for t, r in ratio.items()}
        self.other = -0.5
        words_in, words_out = (max(1, n) / 1000 for n in rows.get("", (0, 0)))
        seen = {t: (i / words_in, o / words_out) for t, (i, o) in names.items()}
        self.names = {t: float(max(RAREST, np.log((i + 1) / (o + 1 + PRIOR * (t in MARKED))))) for t in MARKED | seen.keys() for i, o in [seen.get(t, (0, 0))]}

    def names_none(self, e: Element, in_article: bool) -> bool:
        """Whether the element's role, class or id tells that it holds no content."""
        if e.named or not e.names or e.tag in ("html", "body", "main"):
            return e.named
        say = [0 if in_article and p in IN_ARTICLE else self.names.get(p, 0) for p in e.names[0]] if len(e.names) == 1 else None
        means = [sum(say) / len(say)] if say else [sum(0 if in_article and p in IN_ARTICLE else self.names.get(p, 0) for p in parts) / len(parts) for parts in e.names]
        return min(means) <= (LEFT_OUT if e.tag in CONTAINERS else LEFT_OUT_BLOCK)

    def marked_only(self, e: Element) -> bool:
        """Whether all words of the element's class and id say that it holds no content."""
        return bool(e.names) and all(self.names.get(p, 0) < 0 for parts in e.names for p in parts)

    def left_out(self, tokens: list[tuple[str, str, int]], elements: list[Element]) -> tuple[list[bool], list[bool]]:
        """For each element whether it is left out, and whether it is in an article."""
        n = len(elements)
        words, articles = [0] * n, [0] * n
        for tag, text, e in tokens:
            if not tag:
                words[e] += len(text.split())
        plain = list(words)  # words in no element below that is left out, and in no link
        inside, none, block = [False] * n, [False] * n, [0] * n
        for k, e in enumerate(elements[1:], 1):
            none[k] = e.tag in SKIPPED or (e.tag == "header" and not inside[e.parent]) or self.names_none(e, inside[e.parent])
            inside[k] = inside[e.parent] or (e.tag == "article" and not none[k])
            articles[k] = int(e.tag == "article" and not none[k])
        for k in range(n - 1, 0, -1):
            e = elements[k]
            words[e.parent] += words[k]
            articles[e.parent] += articles[k]
            if not none[k] and e.tag not in NO_TEXT and e.tag != "a":
                plain[e.parent] += plain[k]
            # the most words that one block of content below holds
            block[e.parent] = max(block[e.parent], block[k], words[k] if e.tag in BLOCK_OF_CONTENT and not none[k] else 0)

        def wrapper(k: int, outside: int) -> bool:
            e = elements[k]
            if articles[0]:
                return 2 * words[k] > words[0] and articles[k] == articles[0]
            if e.tag in ("html", "body", "main"):
                return outside <= FRAME
            if e.named or (e.tag in SKIPPED and e.tag != "form") or 2 * block[k] <= plain[k]:
                return False
            return outside <= (FRAME if e.tag != "form" and self.marked_only(e) else max(FRAME, FRAME_SHARE * words[k]))

        out, around = [False] * n, [plain[0]] * n  # around: the words in no element left out, wrappers around this one opened
        for k, e in enumerate(elements[1:], 1):
            around[k] = around[e.parent]
            out[k] = out[e.parent] or e.tag in NO_TEXT
            if none[k] and not out[k]:
                out[k] = not wrapper(k, around[k])
                around[k] += 0 if out[k] else plain[k]
            inside[k] = inside[e.parent] or (e.tag == "article" and not out[k])
        return out, inside

    def scan(self, page: str) -> list[tuple[str, str, bool]]:
        """The best run of the page's tokens, as (tag, text, off)."""
        tokens, elements = parse(page)
        out, inside = self.left_out(tokens, elements)
        has_article = any(inside[e] and not out[e] and text.strip() for _, text, e in tokens)
        best = total = 0.0
        start = first = last = 0
        kept = []
        for k, (tag, text, e) in enumerate(tokens):
            within = has_article and inside[e]  # what an article holds besides its text parts nothing
            off = out[e] or (has_article and not inside[e])
            kept.append((tag, text, off))
            if tag:
                total += 0 if within else self.tags.get(tag, self.other)
            elif not (off and within):
                total += len(text.split()) * (-self.word if off else self.word)
            if total <= 0:
                total, start = 0.0, k + 1
            elif total > best:
                best, first, last = total, start, k + 1
        return kept[first:last]

    def text(self, page: str | None) -> str:
        """The content's blocks, one a line."""
        blocks, open_ = [], []
        for tag, text, off in [*self.scan(page or ""), ("p", "", False)]:
            if text and not off:
                open_.append(text)
            elif tag.removeprefix("/") in BLOCKS:
                if block := " ".join(html.unescape("".join(open_)).split()):
                    blocks.append(block)
                open_ = []
        return "\n".join(blocks)


def features(page: str) -> tuple[Counter, Counter]:
    """Words (""), tags and words under each word of a class (with a dot before it), inside and outside the page's article."""
    tokens, elements = parse(page)
    counts, content, names = (Counter(), Counter()), [False], [frozenset()]
    for e in elements[1:]:
        content.append(content[e.parent] or e.tag == "article")
        own = {f".{p}" for parts in e.names for p in parts}
        names.append(names[e.parent] | own if own else names[e.parent])
    for tag, text, e in tokens:
        into, n = counts[not content[e]], 1 if tag else len(text.split())
        into[tag] += n
        if not tag and n:
            into.update(dict.fromkeys(names[e], n))
    return counts


def train(pages: DataFrame) -> Weights:
    """Count words, tags and words of classes inside and outside the article of about TRAIN_PAGES pages that have just one."""
    labelled = pages.where(F.regexp_count("html", F.lit("(?i)<article[ >]")) == 1)
    near = hash_below(F.coalesce("url", F.lit("")), F.lit(min(1.0, TRAIN_PAGES / max(1, pages.count()))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch["html"]:
                for total, found in zip((inside, outside), features(page), strict=True):
                    total.update(found)
        names = sorted(inside | outside)
        if names:
            yield pd.DataFrame({"tag": names, "inside": [inside[t] for t in names], "outside": [outside[t] for t in names]})

    counts = labelled.where(near).select("html").mapInPandas(count, "tag string, inside long, outside long")
    total = counts.groupBy("tag").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    return Weights(total.where(F.col("inside") + F.col("outside") >= SEEN).toPandas())  # of the sample's pages, whatever the table


def extract(pages: DataFrame, weights: Weights, name: str = "text") -> DataFrame:
    """pages with the text of each whole page's content."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)  # of what TRAIN_PAGES pages hold

    def run(found: pd.Series) -> pd.Series:
        return found.map(shared.value.text)

    return pages.withColumn(name, F.pandas_udf(run, "string")("html"))


def op5_html(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, train(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
