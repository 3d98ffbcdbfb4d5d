"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of tokens: words, which score positive, and tags, which score negative (Pasternack
and Roth, "Extracting article text from the web with maximum subsequence segmentation", 2009). The
weight of a tag, and of a word by the element and class of the block it stands in, comes from labelled pages:
those that mark their own content with an article or main element. Words of blocks that stand outside the content
there weigh negative, whatever their class is called. One linear scan finds the contiguous region with the greatest
sum. Of that region the blocks are left out that are never part of an article: by their element or class (menus,
adverts, forms, scripts, reader comments and the like), or because labelled pages have a block of that class outside
their content. A stretch of such words outside a marked element weighs negative too, PENALTY at most, so that one in
the middle of an article does not split it.

Defined results: a null or empty html, or one without content, gives ""; unclosed, stray and
truncated tags are tolerated; of equal regions the first wins; repeated rows give repeated results; pages of any
length are read whole; without labelled pages the default weights hold; an empty table gives no rows; other columns
are ignored, whatever they are called.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import per_row, small_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Element and class names; fixed values.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "select", "option", "object", "canvas"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
APART = {"nav", "aside", "form", "footer", "menu", "dialog", "button", "head", "fieldset"}
APART_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|complementary|consent|contentinfo|cookies?|disqus|footer|login|masthead|menu|modal|nav\w*|newsletter|notices?|popup|promo\w*|related|search|share|sharing|sidebar|social|sponsor\w*|subscribe|widget)(?:$|[\s_-])",
    re.I,
)
MAIN = {"article", "main"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_HOLDS = {"article", "aside", "body", "div", "footer", "form", "header", "html", "main", "nav", "section", "table", "td", "th", "ul", "ol", "dl"}
CONTENT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "table", "tr", "td", "th", "figcaption"}
WORD_DEFAULT, TAG_DEFAULT, TAG_LEAST, APART_DEFAULT, PENALTY = 1.0, -2.0, -0.25, -1.0, 6.0
#: A class of blocks is left out from this weight down, where labelled pages hold so many of its words at least.
LEFT_OUT, EVIDENCE = -1.0, 20


def tokens(page: str) -> Iterator[tuple]:
    """("tag", name, opens, block, apart) and ("text", text, context, apart, in_main) in page order."""
    stack: list[tuple[str, bool, str]] = []  # name, apart from the content, class of block
    at, n = 0, len(page)
    lower = None

    def state() -> tuple[bool, str]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, "")

    inside = 0  # main elements open
    for m in _TOKEN.finditer(page):
        if m.start() < at:  # within raw content
            continue
        if m.start() > at:
            yield "text", page[at : m.start()], *(state()[::-1]), inside > 0
        at = m.end()
        name = m.group(2)
        if not name:
            continue
        name = name.lower()
        if not m.group(1):
            if name in _CLOSES_P or name == "li":
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == ("li" if name == "li" else "p"):
                        del stack[k:]
                        break
                    if stack[k][0] in _HOLDS:
                        break
            if name in RAW:
                lower = lower if lower is not None else page.lower()
                end = lower.find(f"</{name}", at)
                close = page.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else n
                continue
            apart, context = state()
            own = False
            if name not in VOID:
                marks = " ".join(a or b or c for a, b, c in _MARK.findall(m.group(3))) if m.group(3) else ""
                own = name in APART or (name == "header" and not inside) or bool(marks and APART_MARKS.search(marks))
                key = context if apart or (name in INLINE and not own) else f"{name}.{marks}" if marks else name
                stack.append((name, apart or own, key))
                inside += name in MAIN
            yield "tag", name, True, name not in INLINE, apart or own
        else:
            apart = state()[0]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    inside -= sum(x[0] in MAIN for x in stack[k:])
                    del stack[k:]
                    break
            yield "tag", name, False, name not in INLINE, apart
    if at < n:
        rest = page[at:]
        yield "text", rest.partition("<")[0] if re.match(r"[^<]*<[a-zA-Z/!]", rest) else rest, *(state()[::-1]), inside > 0


def observed(page: str) -> Counter:
    """For one labelled page: how often each feature stands inside and outside its marked content."""
    out: Counter = Counter()
    inside = 0
    for kind, a, b, c, *rest in tokens(page):
        if kind == "tag":
            if a in MAIN:
                inside += 1 if b else -1
                out[f"<{a}", False] += 1
            elif not rest[0]:
                out[f"<{a}", inside > 0] += 1
        else:
            out[b, rest[0] and not c] += len(a.split())
    return out


class Weights:
    """Log-odds of features, smoothed: of words by their block, at most 1; of tags, below 0."""

    def __init__(self, counts: dict[tuple[str, bool], int]):
        totals = {v: sum(n for (_, y), n in counts.items() if y == v) for v in (True, False)}
        self.words, self.tags, self.left_out = {}, {}, set()
        for f in sorted({f for f, _ in counts}):
            yes, no = ((counts.get((f, v), 0) + 1) / (totals[v] + 2) for v in (True, False))
            odds = math.log(yes / no)
            if f.startswith("<"):
                self.tags[f[1:]] = max(-6.0, min(TAG_LEAST, odds))
            else:
                self.words[f] = max(-2.0, min(WORD_DEFAULT, odds))
                if "." in f and odds <= LEFT_OUT and counts.get((f, False), 0) >= EVIDENCE:
                    self.left_out.add(f)


def best_region(scores: list[float]) -> tuple[int, int]:
    """(first, end) of the contiguous region with the greatest sum, the first of equal ones; empty if none is above 0."""
    best, found, here, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if here <= 0:
            here, start = 0.0, i
        here += x
        if here > best:
            best, found = here, (start, i + 1)
    return found


def scored(page: str, weights: Weights) -> tuple[list[float], list[str | None]]:
    """The scores of a page's tokens, and their text: None where a block ends, "" where they are left out."""
    scores, texts, spent = [], [], 0.0
    for kind, a, b, c, last in tokens(page):
        if kind == "tag":
            scores.append(0.0 if last else weights.tags.get(a, TAG_DEFAULT if c and a not in CONTENT else TAG_LEAST))
            texts.append(None if c else " " if a == "br" else "")
        else:
            apart, n = c, len(a.split())
            if not c and not last and b in weights.left_out:
                apart = True
            if apart:
                score = 0.0 if last else -min(PENALTY - spent, -n * min(0.0, weights.words.get(b, APART_DEFAULT)))
                spent -= score
            else:
                score = n * weights.words.get(b, WORD_DEFAULT)
                spent = 0.0 if n else spent
            scores.append(score)
            texts.append("" if apart else a)
    return scores, texts


def extract(page: str | None, weights: Weights) -> str:
    scores, texts = scored(page or "", weights)
    first, end = best_region(scores)
    blocks: list[list[str]] = [[]]
    for text in texts[first:end]:
        if text is None:
            blocks.append([])
        else:
            blocks[-1].append(text)
    found = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(t for t in found if t)


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def learn(pages: DataFrame, sample: int = 400) -> Weights:
    """Weights from at most `sample` labelled pages, chosen by a hash of page_id, of the given pages.

    The counts of their features come to the driver, as many as they have distinct tags and classes.
    """
    spark = pages.sparkSession
    small_batches(spark, 128)
    ids = pages.where("html rlike '(?i)<(article|main)[\\\\s>]'").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for (h,) in zip(b.column(0).to_pylist(), strict=True):
                counts.update(observed(h or ""))
        yield pa.RecordBatch.from_pylist([{"f": f, "y": y, "n": n} for (f, y), n in counts.items()], schema=pa.schema([("f", pa.string()), ("y", pa.bool_()), ("n", pa.int64())]))

    rows = pages.select("page_id", "html").join(F.broadcast(ids), "page_id", "left_semi").select("html").limit(sample).mapInArrow(run, "f string, y boolean, n long")
    return Weights({(r["f"], r["y"]): r["n"] for r in rows.groupBy("f", "y").agg(F.sum("n").alias("n")).collect()})


def main_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text and n_chars of every page. Nothing is shuffled."""
    small_batches(pages.sparkSession, 128)
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def make():
        def row(page_id, url, page):
            text = extract(page, shared.value)
            return page_id, url, text, len(text)

        return row

    return pages.select("page_id", "url", "html").mapInArrow(per_row(["page_id", "url", "html"], TEXTS, make), "page_id long, url string, text string, n_chars long")
