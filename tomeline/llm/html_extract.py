"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive, tags negative; one
linear scan finds the contiguous stretch with the largest sum, and its blocks are the
text.  The scores are log-odds from labelled pages: those whose author marked the
content with one <article> or <main> element say which tokens, and which class words
and roles, lie inside and which outside.  Inside such an element every token gains
WITHIN, and no stretch crosses the element's border, so where pages have one the
best stretch is all of the best one.  The sample is bounded (SAMPLE pages with the
least hash of page_id, of up to SAMPLE_CHARS characters); without labelled pages
DEFAULTS hold.

Elements which are not content wherever they stand (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments, scripts, styles) neither
score nor appear in the text.  They are known by element or role, or by the words of
class and id: each has a weight, from PRIOR and from the labelled pages, and an element
is left out if the weights of a name add up to HIDES or less.  What a name says that
the element has or lacks (has-sidebar, no-ads) doesn't count.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed, empty ones left out, and the rest joined by an empty
line in page order.  A line break element is white space.

Defined results: null or empty html, or no words: empty text.  Of stretches with equal
sums the first and shortest.  Unclosed elements: paragraphs end at the next block, list
items, terms and parts of tables at the next of their kind, and all of them where the
element around them ends; an unclosed drawing ends at the next tag of HTML, an unclosed
advert or similar inside a content element at the next block, and elsewhere where
<article> or <main> begins.  A tag without end is text.  Time is linear in a page's length.
Rows are handled one by one, so repeated or null page_ids are fine.  Further columns
are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 300
SAMPLE_CHARS = 200_000
CONTENT = {"article", "main"}
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "select", "button", "textarea", "canvas", "math"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"} | SILENT
#: Elements around an <article> that is not the page's: cards of other articles and comments.
AROUND_CARDS = {"nav", "aside", "footer", "dialog", "menu"}
#: Weights of words in class and id names before anything is learned.
PRIOR = (
    dict.fromkeys("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr popup modal overlay newsletter subscribe signup sidebar comment comments commentlist disqus respond reply replies related recommended recommendations breadcrumb breadcrumbs nav navbar navigation menu footer share sharing social widget widgets".split(), -3.0)
    | dict.fromkeys("masthead toolbar pagination pager login notice alert".split(), -2.0)
    | dict.fromkeys("header foot search side".split(), -1.5)
    | dict.fromkeys("role navigation, role banner, role contentinfo, role complementary, role search, role alert, role dialog, role form, role menu".split(", "), -3.0)
    | dict.fromkeys("layout wrapper wrap container".split(), 1.5)
    | dict.fromkeys("article content main post entry story text body".split(), 1.0)
    | dict.fromkeys("page results grid row col column section inner outer".split(), 0.5)
)
HIDES = -1.5
#: Bounds of a learned weight, and the occurrences at which half of it counts.
LEARNED, HALF = 3.0, 20
#: What tokens inside a content element gain.
WITHIN = 2.0
#: A stretch never crosses the border of a content element.
BORDER = -1e18
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "tr", "thead", "tbody", "tfoot", "caption", "blockquote", "pre", "section", "figure", "figcaption", "hr", "address", "details", "summary", "fieldset", "legend", "body", "html", "center"} | CONTENT | ASIDE
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "!doctype"}
SPACES = {"br", "td", "th", "wbr"}
_PARTS = {"thead", "tbody", "tfoot"}
CELLS = {"td", "th", "tr"} | _PARTS
#: Elements whose end tag may be left out: the start tags that end them, and which end tags of such elements do.
OPEN_ENDED = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": CELLS, "th": CELLS, "tr": {"tr"} | _PARTS} | dict.fromkeys(sorted(_PARTS), _PARTS)
AROUND = {"p": {"li", "dt", "dd"} | CELLS, "td": {"tr"} | _PARTS, "th": {"tr"} | _PARTS, "tr": _PARTS}
DEFAULTS = {"word": 0.3, "link word": -0.5, "tag": -0.4} | {f"{mark}{name}": -0.05 for name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "b", "i", "em", "strong") for mark in ("<", "</")}
#: Bounds of a tag's learned score.
TAG_SCORES = -0.5, -0.05

_REST = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    # A drawing closed in its own tag is empty; one never closed ends where HTML goes on.
    rf"|<(svg)\b{_REST}>(?:(?<=/>)|(?:(?!<svg\b).)*?</svg\s*>|.*?(?=</?(?:p|div|h[1-6]|[uod]l|li|d[td]|table|t[rdh]|article|main|section|header|footer|nav|aside|body|span|em|strong|img|br)\b|\Z))"
    rf"|<(/?)([a-zA-Z!][^\s/<>]*+)({_REST}|[^<>]*+)>|[^<]+|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
#: What a name says that the element has or lacks is not what it is: has-sidebar, page-with-sidebar, no-ads.
_HELD = re.compile(r"(?:^|(?<=[\s_-]))(?:has|with|without|no)[_-]\S*", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _names(attributes: str) -> list[list[str]]:
    """The words of each name in class and id; a role is one word."""
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            out.append([f"role {value.strip().lower()}"])
        else:
            out += [w for name in _HELD.sub("", value).split() if (w := [x.lower() for x in _WORD.findall(name)])]
    return out


def _is_aside(name: str, attributes: str, names: dict[str, float]) -> bool:
    if name in ASIDE:
        return True
    if name in ("body", "html") or not attributes:
        return False
    return any(sum(names.get(w, 0.0) for w in words) <= (HIDES if name not in CONTENT else 2 * HIDES) for words in _names(attributes))


def _left_open(found: list[tuple[int, str, bool, bool]]) -> set[int]:
    """Of the tags (place, name, closing, own) those that open an element inside a content
    element and don't close it before that ends."""
    out: set[int] = set()
    open_: dict[str, list[int]] = {}
    marks: list[tuple[str, dict[str, int]]] = []
    for at, name, closing, own in found:
        if name in CONTENT:
            if not closing:
                marks.append((name, {k: len(v) for k, v in open_.items()}))
            elif marks and marks[-1][0] == name:
                before = marks.pop()[1]
                for k, v in open_.items():
                    out.update(v[before.get(k, 0) :])
                    del v[before.get(k, 0) :]
        elif name in OPEN_ENDED:
            continue
        elif closing:
            if (v := open_.get(name)) and (not marks or len(v) > marks[-1][1].get(name, 0)):
                v.pop()
        elif own:
            open_.setdefault(name, []).append(at)
    return out


def _within(hidden: str, inside: Counter) -> bool:
    """Whether an element open in the hidden one keeps what follows in it."""
    return inside["table"] > 0 if hidden in CELLS else any(n > 0 for k, n in inside.items() if k not in ("div", "address"))


def _ends(hidden: str, name: str, closing: bool, inside: Counter) -> bool:
    """Whether a tag other than its own end tag ends the hidden element."""
    if name not in BLOCKS and name not in OPEN_ENDED:
        return False
    if not closing:
        return name in OPEN_ENDED[hidden] and not _within(hidden, inside)
    if name in OPEN_ENDED:
        return name in AROUND.get(hidden, ()) and not _within(hidden, inside)
    return inside[name] <= 0 and (name == "table" or hidden not in CELLS)


def tokens(page: str, names: dict[str, float] = PRIOR) -> list[tuple[str, str, bool, bool]]:
    """(kind, value, shown, within) of a page: kind is a tag such as '<p' or '</p', or
    'word' or 'link word' for a text; shown is False inside what is never content, and
    within is True inside a content element."""
    found = [(m[4] and m[4].lower(), m) for m in _TOKEN.finditer(page)]
    own = lambda name, m: not (m[5] or "").rstrip().endswith("/") and name not in VOID
    left_open = _left_open([(i, name, bool(m[3]), own(name, m)) for i, (name, m) in enumerate(found) if name])
    out, hidden, depth, link, around = [], "", 0, False, 0
    inside: Counter = Counter()  # elements open within a hidden one whose end tag may be left out
    for i, (name, m) in enumerate(found):
        if name is None:
            text = m[0]
            if m[1] is None and m[2] is None and not text.startswith("<!--"):
                out.append(("link word" if link else "word", text, not hidden, around > 0))
            continue
        closing = bool(m[3])
        opens = not closing and own(name, m)
        if hidden and opens and name in CONTENT and hidden not in SILENT and (name == "main" or hidden not in AROUND_CARDS) and not _is_aside(name, m[5] or "", names):
            hidden = ""
        if hidden in OPEN_ENDED:
            if _ends(hidden, name, closing, inside):
                hidden = ""
            elif (name in BLOCKS and name not in OPEN_ENDED) and (closing or opens):
                inside[name] += -1 if closing else 1
        if hidden:
            if name == hidden and hidden in OPEN_ENDED:
                if closing and not _within(hidden, inside):
                    hidden = ""
            elif name == hidden:
                depth += -1 if closing else opens
                if depth == 0:
                    hidden = ""
            out.append((("</" if closing else "<") + name, "", False, around > 0))
            continue
        if opens and _is_aside(name, m[5] or "", names):
            hidden, depth = "p" if i in left_open else name, 1
            inside.clear()
            out.append(("<" + name, "", False, around > 0))
            continue
        if name == "a":
            link = opens
        if name in CONTENT:
            around = max(0, around + (-1 if closing else opens))
        out.append((("</" if closing else "<") + name, "", True, around > 0))
    return out


def train(pages: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Scores of words and tags, and weights of class words and roles, from pages with
    one content element."""
    inside, outside = Counter(), Counter()
    names_in, names_out = Counter(), Counter()
    for page in pages:
        within = 0
        for kind, value, _, _ in tokens(page):
            if kind[0] == "<" and kind.lstrip("</") in CONTENT:
                within = max(0, within + (1 if kind[1] != "/" else -1))
                continue
            (inside if within else outside)[kind] += len(value.split()) if kind[0] != "<" else 1
        within, open_ = 0, []
        for m in _TOKEN.finditer(page):
            name = (m[4] or "").lower()
            if name in CONTENT:
                within = max(0, within + (-1 if m[3] else 1))
                open_ = [] if not m[3] else open_  # what is open around the content element holds it: no sign of anything
            elif name and m[3]:
                at = next((i for i in range(len(open_) - 1, max(len(open_) - 50, 0) - 1, -1) if open_[i][0] == name), None)
                if at is not None:
                    for _, inner, words in open_[at:]:
                        (names_in if inner else names_out).update(words)
                    del open_[at:]
            elif name and name not in VOID and not (m[5] or "").rstrip().endswith("/"):
                open_.append((name, within > 0, {w for words in _names(m[5] or "") for w in words}))
    if not inside:
        return DEFAULTS, PRIOR
    total_in, total_out = sum(inside.values()), sum(outside.values())
    odds = {k: math.log((inside[k] + 0.5) / (total_in + 1)) - math.log((outside[k] + 0.5) / (total_out + 1)) for k in inside | outside}
    # Tags that the sample never shows inside still occur in other articles.
    out = {k: min(max(v, TAG_SCORES[0]), TAG_SCORES[1]) if k[0] == "<" else v for k, v in odds.items()}
    # Only words that are signs of asides before can become stronger ones: a class that the sample has outside
    # only may as well be a frame around the content of other pages.
    names = dict(PRIOR)
    for w in names_in | names_out:
        n = names_in[w] + names_out[w]
        v = math.log((names_in[w] + 0.5) / (names_out[w] + 0.5)) * n / (n + HALF)
        floor = -LEARNED if PRIOR.get(w, 0.0) < 0 else 0.0
        names[w] = min(max(PRIOR.get(w, 0.0) + v, floor), LEARNED)
    return DEFAULTS | out | {"word": max(odds.get("word", 0.3), 0.3)}, names


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Start and end of the stretch with the largest positive sum; (0, 0) if there is none."""
    best, run, first, span = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        run += s
        if run <= 0:
            run, first = 0.0, i + 1
        elif run > best:
            best, span = run, (first, i + 1)
    return span


def token_scores(t: list[tuple[str, str, bool, bool]], weights: dict[str, float]) -> list[float]:
    out = []
    for kind, value, shown, within in t:
        if not shown:
            out.append(0.0)
        elif kind[0] == "<":
            out.append(BORDER if kind.lstrip("</") in CONTENT else weights.get(kind, weights["tag"]) + WITHIN * within)
        else:
            out.append((weights[kind] + WITHIN * within) * len(value.split()))
    return out


def content(page: str, model: tuple[dict[str, float], dict[str, float]]) -> str:
    """The blocks of the best stretch, joined by an empty line."""
    weights, names = model
    t = tokens(page, names)
    start, end = best_stretch(token_scores(t, weights))
    blocks, now = [], []
    for kind, value, shown, _ in t[start:end]:
        if kind[0] != "<":
            if shown:
                now.append(value)
        elif (name := kind.lstrip("</")) in BLOCKS:
            blocks.append(now)
            now = []
        elif name in SPACES:
            now.append(" ")
    return "\n\n".join(b for b in (" ".join(entities.unescape("".join(x)).split()) for x in [*blocks, now]) if b)


def fit(pages: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """The scores, from up to SAMPLE labelled pages.  Their ids are chosen first, so that
    texts of SAMPLE pages and no more go to the driver."""
    one = F.lower("html").rlike(r"<(article|main)[\s>]") & (F.length("html") <= SAMPLE_CHARS)
    labelled = pages.where(one).withColumn("sign", F.xxhash64("page_id", "html"))
    signs = [r.sign for r in labelled.select("page_id", "sign").orderBy(F.xxhash64("page_id"), "sign").limit(SAMPLE).select("sign").collect()]
    rows = labelled.where(F.col("sign").isin(signs)).select("html").distinct().collect() if signs else []
    return train(sorted(r.html for r in rows))


def _extract(model):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [content(h.as_py() or "", model) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(x) for x in texts], np.int64))], schema=schema)

    return run


def extract(pages: DataFrame, model: tuple[dict[str, float], dict[str, float]] | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    model = model or fit(pages)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
