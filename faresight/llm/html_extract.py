"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of tokens: words, which score positive, and tags, which
score negative; a run of side elements (menus, adverts, forms and the like) is
one negative token, whatever they hold. One linear scan finds the contiguous region of the highest
score, which is the article. Weights come from labelled pages: pages that
mark their own content with a single <article> or <main> element tell for
each kind of token how much more often it stands outside than inside. On a
page with such a mark, words outside it score negative, and tags and side
elements inside it hardly count.

An element is a side element by its tag or role, or by its class or id. A
name that says what the element is ("sidebar", "cookie-notice",
"comment-list") makes it one, unless it holds the page's only <article> or
<main> and is no list of comments. A name that may also stand for a wrapper
("content-sidebar-wrap", "has-sidebar") costs as much as a side element at
its start and end, and competes in the scan: an element that the best region
lies in is a wrapper, any other is a side. If nothing were left, names count
for nothing.

The region's words that stand in such side elements (an advert inside an
article) are left out. Character references are decoded, white space in a
block becomes one space, blocks are joined by two newlines.

Weights are fitted on at most ``SAMPLE`` labelled pages (by hash order);
without any, ``PRIOR`` holds.

Defined results: a null or empty page, and one without words, give an empty
text; a page without tags is its own text; unclosed and stray tags are
tolerated; a quote opens a value only after "="; very long and deep pages
take time in proportion to their length; of equally good regions the first
and longest counts; repeated rows give the same text; an empty table gives an empty
table. Only the named columns are read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.llm.common import map_arrow, materialize, table

SAMPLE = 4_000
#: Largest weight of one token.
LIMIT = 4.0
#: Weights without labelled pages: a word, a word in a link, a word outside
#: the content that a page marks, a side element, any tag; then a side
#: element and any tag inside marked content.
PRIOR = {"word": 1.0, "link": -0.5, "out": -1.0, "side": -5.0, "tag": -0.2, "side inside": -0.5, "tag inside": -0.05}

# HTML element groups and the usual names of side elements.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "select", "math"}
SIDE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head", "label", "option", "fieldset"}
CLOSED_BY_NEXT = {"p", "li", "a", "option", "dt", "dd", "tr", "td", "th"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "area", "audio", "b", "basefont", "bdi", "bdo", "big", "blink", "br", "button",
          "canvas", "cite", "code", "data", "del", "dfn", "em", "embed", "font", "i", "iframe", "img", "input", "ins",
          "kbd", "label", "map", "mark", "math", "meter", "nobr", "noscript", "object", "output", "param", "picture",
          "progress", "q", "rb", "rp", "rt", "rtc", "ruby", "s", "samp", "script", "select", "slot", "small", "source",
          "span", "strike", "strong", "style", "sub", "sup", "svg", "template", "textarea", "time", "track", "tt", "u",
          "var", "video", "wbr"}
SIDE_NAMES = ("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar "
              "menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent notice notices alert comment "
              "comments disqus reply replies respond share sharing social related recommended recommendations newsletter "
              "subscribe subscription signup login search widget footer header masthead toolbar pagination popup modal "
              "gdpr skip toc").split()
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu",
              "menubar", "alertdialog"}

#: Names of side elements that no wrapper of an article has, but with a word of WITH.
ALWAYS = frozenset("advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies "
                   "consent gdpr comment comments disqus reply replies respond related recommended recommendations "
                   "newsletter subscribe subscription signup login".split())
#: What readers write.
TALK = frozenset("comment comments disqus reply replies respond".split())
#: Words beside a name that leave it what it is, and ones that make it a property.
BESIDE = frozenset("list area box section block bar container item left right top bottom primary secondary site "
                   "global".split())
WITH = frozenset("no has with without is hide show".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>][^\s=/>]*+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SIDE_NAMES = frozenset(SIDE_NAMES)


def _name_says(value: str, inside: bool) -> str:
    """"talk", "name" or "maybe" (a side or a wrapper) by a class or id, or ''."""
    why = ""
    for one in value.split():
        parts = {x.lower() for x in _NAME.findall(one)}
        sides = parts & _SIDE_NAMES
        if inside:
            sides -= {"header", "masthead"}
        if not sides:
            continue
        if not parts & WITH and (parts & ALWAYS or parts != {"widget"} and parts <= sides | BESIDE):
            if parts & TALK:
                return "talk"
            why = "name"
        else:
            why = why or "maybe"
    return why


def _is_side(tag: str, attributes: str, inside: bool) -> str:
    """Why an element is no content: its "kind", or what a name in its class
    or id says; '' if it is content. A header inside an article is, and <article>
    by a name that may be a wrapper's."""
    if tag in SIDE or (tag == "header" and not inside):
        return "kind"
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return ""
    why = ""
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id"):
            if tag not in ("html", "body", "main") and why != "talk":
                says = _name_says(value.strip("\"'"), inside)
                if says in ("talk", "name") or not why and says and tag != "article":
                    why = says
            continue
        value = value.strip("\"'").lower()
        if name == "role":
            if value in SIDE_ROLES:
                return "kind"
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return "kind"
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return "kind"
    return why


Token = tuple[str, str, bool, bool]
#: Where an element with a "maybe" name starts on the page, and its first and last token.
Maybe = tuple[int, int, int]


def tokens(page: str, forms: bool = True, names: bool = True,
           asides: frozenset[int] = frozenset()) -> tuple[list[Token], list[Maybe]]:
    """(kind, text or tag, inside marked content, block boundary) in page
    order, and the elements that may be sides or wrappers.

    kind: word (a run of text), link (one in a link), out (a word outside
    the content that the page marks), side (the start of a side element),
    hidden (what a side element holds), maybe (the start or end of an element that
    may be a side) or tag. Raw elements are passed over whole. ``forms``: whether a
    form is a side element; ``names``: whether an element is one by its class
    or id; ``asides``: where elements start that may be sides and are."""
    out, maybe, holding = _tokens(page, forms, names, asides, frozenset())
    return _tokens(page, forms, names, asides, holding)[:2] if holding else (out, maybe)


def _tokens(page: str, forms: bool, names: bool, asides: frozenset[int],
            spared: frozenset[int]) -> tuple[list[Token], list[Maybe], frozenset[int]]:
    """Also where the elements start that are no sides though their names
    say so: they hold marked content. ``spared``: those of an earlier pass."""
    out: list[Token] = []
    maybe: list[Maybe] = []
    stack: list[tuple[str, str, int, int]] = []            # open elements: name, why, start, first token
    opened: Counter[str] = Counter()                       # of each name
    named: list[int] = []                                  # start of each open one by name, -1: a firm side
    side = links = main = 0
    holding: set[int] = set()
    shown = False                                          # marked content in no side
    at, end = 0, len(page)

    def text(piece: str) -> None:
        if piece:
            out.append(("hidden" if side else "link" if links else "word", piece, main > 0, False))

    def leave() -> tuple[str, str]:
        nonlocal side, links, main
        name, why, start, first = stack.pop()
        opened[name] -= 1
        if why == "maybe":
            maybe.append((start, first, len(out)))
        elif why:
            side -= 1
            named.pop()
        links -= name == "a"
        main -= name in ("article", "main")
        return name, why

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        block = tag not in INLINE
        if m[1]:                                # a closing tag closes what is open inside it
            why, hidden = "", side > 0
            if opened[tag]:
                name = ""
                while name != tag:
                    name, why = leave()
            out.append(("hidden" if hidden else "maybe" if why == "maybe" else "tag", tag, main > 0, block))
            continue
        if tag == "body":                       # an open head ends here
            while stack:
                leave()
        elif tag in CLOSED_BY_NEXT and stack and stack[-1][0] == tag:
            leave()
        why = "" if tag in RAW or tag in VOID or not forms and tag == "form" else _is_side(tag, m[3], main > 0)
        if why not in ("", "kind") and (not names or m.start() in spared):
            why = ""
        if why == "maybe" and m.start() in asides:
            why = "name"
        if why == "maybe" and side:
            why = ""
        own = why not in ("", "maybe")
        if tag in ("article", "main") and not own:
            shown |= side == 0
            for start in reversed(named):
                if start < 0 or start in holding:          # what is around a holding one holds it too
                    break
                holding.add(start)
        out.append(("hidden" if side else "side" if own else "maybe" if why else "tag", tag, main > 0, block))
        if tag in RAW:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = close.end() if close else end
        elif tag not in VOID:
            stack.append((tag, why, m.start(), len(out) - 1))
            opened[tag] += 1
            if own:
                side += 1
                named.append(m.start() if why == "name" else -1)
            links += tag == "a"
            main += tag in ("article", "main")
    while stack:
        leave()
    if shown:                                  # teasers of other articles
        holding.clear()
    marked = any(inside for kind, _, inside, _ in out if kind == "word")
    return [("out" if marked and kind == "word" and not inside else kind, t, inside, block)
            for kind, t, inside, block in out], maybe, frozenset(holding)


def weight(weights: dict[str, float], kind: str, text: str, inside: bool) -> float:
    if kind == "hidden":
        return 0.0
    if kind in ("side", "maybe"):
        return weights["side inside"] if inside else weights["side"]
    if kind == "tag":
        w = weights.get("tag:" + text, weights["tag"])
        return max(w, weights["tag inside"]) if inside else w
    if kind == "link" and inside:
        return weights["word"] * len(text.split())
    return weights[kind] * len(text.split())


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous part with the largest positive sum (the first and
    longest of equal ones), by one scan; (0, 0) if there is none."""
    best, lo, hi, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best and best > 0 and start == lo:
            best, lo, hi = total, start, i + 1
    return lo, hi


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    for names in (True, False):                 # without names only for what would be empty
        seq, maybe = tokens(page, names=names)
        forms = any(kind in ("word", "link") and t.strip() for kind, t, _, _ in seq)
        if not forms:                           # pages that are one large form
            seq, maybe = tokens(page, forms, names)
        if maybe:
            lo, hi = best_region(_scores(seq, weights))
            asides = frozenset(start for start, first, last in maybe if lo < first or hi > last)
            if asides:
                seq, _ = tokens(page, forms, names, asides)
        text = _region_text(seq, weights)
        if text:
            break
    return text


def _scores(seq: list[Token], weights: dict[str, float]) -> list[float]:
    """Weights of the tokens; side elements without words between count once."""
    out, after = [], False
    for kind, t, inside, _ in seq:
        out.append(0.0 if after and kind == "side" else weight(weights, kind, t, inside))
        if kind == "side":
            after = True
        elif kind in ("word", "link", "out") and t.strip():
            after = False
    return out


def _region_text(seq: list[Token], weights: dict[str, float]) -> str:
    lo, hi = best_region(_scores(seq, weights))
    blocks, parts = [], []
    for kind, t, _, boundary in seq[lo:hi]:
        if kind in ("tag", "side", "maybe") or kind == "hidden" and boundary:
            if boundary:
                blocks.append(parts)
                parts = []
            elif t == "br":
                parts.append(" ")
        elif kind != "hidden":
            parts.append(html.unescape(t))
    blocks.append(parts)
    return "\n\n".join(b for b in (" ".join("".join(p).split()) for p in blocks) if b)


def learn_weights(pages: DataFrame, page_id: str = "page_id", payload: str = "html",
                  sample: int = SAMPLE) -> dict[str, float]:
    """Token weights from pages with one <article> or <main>: the negative
    log(1 + odds) of standing outside, a word at 1."""
    body = F.coalesce(F.col(payload), F.lit(""))
    marked = F.regexp_count(body, F.lit(r"(?i)<(article|main)[\s>]")) == 1
    ids = materialize(pages.where(marked & F.col(page_id).isNotNull()).select(F.col(page_id).alias("_id")).distinct()
                      .orderBy(F.md5(F.col("_id").cast("string"))).limit(sample), "html_labelled")
    rows = pages.select(F.col(page_id).alias("_id"), F.col(payload).alias("html")).where(marked).join(
        F.broadcast(ids), "_id", "left_semi")          # at most ``sample`` ids

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        n: Counter[tuple[str, bool]] = Counter()
        for page in b.column(0).to_pylist():
            for kind, t, inside, _ in tokens(page)[0]:
                if kind == "tag":
                    n["tag:" + t, inside] += 1
                elif kind == "side":
                    n["side", inside] += 1
                elif kind == "link":
                    n["link", inside] += len(t.split())
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in n]), pa.array([i for _, i in n]),
                                           pa.array(list(n.values()), pa.int64())], ["kind", "inside", "n"])

    counted = (map_arrow(rows.select("html"), count, "kind string, inside boolean, n long")
               .groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"),
                                    F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("o")).collect())
    weights = dict(PRIOR)
    for r in counted:
        if r["i"] + r["o"] >= 5:
            weights[r["kind"]] = -min(LIMIT, math.log1p((r["o"] + 0.5) / (r["i"] + 0.5)))
    return weights


def extract(pages: DataFrame, weights: dict[str, float], page_id: str = "page_id", url: str = "url",
            payload: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p, weights) for p in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                           pa.array([len(t) for t in texts], pa.int64())],
                                          ["page_id", "url", "text", "n_chars"])

    key = pages.schema[page_id].dataType.simpleString()
    return map_arrow(pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
                                  F.col(payload).alias("html")), run,
                     f"page_id {key}, url string, text string, n_chars long")


def op7_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn_weights(pages))
