"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of tokens: words score above zero, tags below. The weights are log odds
of a token lying in the article or outside, learned from labelled pages: those that mark their
article themselves with an article or main element, the SAMPLE_PAGES of them with the smallest
hashes; they are counted in the tasks, and only the counts come to the driver. A linear scan finds
the contiguous stretch with the largest total; the innermost sectioning element around it is
the content, or the stretch alone where only the body holds it. Menus, headers, footers, side
bars, adverts, notices, forms and reader comments inside are left out by element and by the
words of their class, id and role, unless the element so marked wraps the content: it holds the
leading main or article element, or at least half of the words outside links (of the leading
element, or of a page without one). Comments, notices about cookies, adverts and links to other
pages are no wrappers by their share of words as long as words remain outside them. What is
marked and holds less is left out, also where an author gave such a name to a part of the text.

Text: character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined in page order by a line end; empty blocks vanish.

Every step is linear in the page: tags are read once, a stray closing tag is known by a count of
open elements, and the element around the stretch is the least deep one between its ends.

Defined cases: a null or empty page, and a page without words, give an empty text; unclosed
and stray tags are tolerated; an unclosed script or comment runs to the end of the page; of
stretches with one total the first is taken; null page_ids and urls are kept as they are;
repeated pages give repeated rows; an empty table gives none; extra columns, also those named
like the operator's own, are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages from which weights are learned, at most.
SAMPLE_PAGES = 300

# Elements by what they mean for text.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "select", "iframe", "object", "canvas", "annotation-xml", "annotation", "title")
SKIPPED = ("nav", "footer", "aside", "form", "button", "dialog", "menu")
SECTIONS = ("html", "body", "main", "article", "section", "div", "td", "center")
BLOCKS = (
    "address article aside blockquote body br button canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav noscript ol optgroup option p pre section summary table tbody tfoot thead tr ul"
).split()
CELLS = ("td", "th")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Words of a class, id or role that mark what is not the article.
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies "
    "disqus footer masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promoted promotion recommended "
    "related replies share sharing sidebar signup sitenav social sponsor sponsored subscribe toolbar widget header topbar complementary search alert".split()
)
#: Those of them that never name what holds an article; marked by others only, an element that holds most words is content.
CLOSED = frozenset("ad ads adv advert adverts advertisement advertising comment comments commentlist consent cookie cookies disqus modal popup replies".split())
LAYOUT = NOT_ARTICLE - CLOSED
WRAPPERS = ("form", "header", "dialog")
#: Words that say that an element only has such a part, and words before ``header`` that make it the article's own.
QUALIFIERS = frozenset("has with without no".split())
HEADED = frozenset("entry post article story".split())

_ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>" + "|".join(RAW) + rf")(?![a-zA-Z0-9:-]){_ATTRIBUTES}>.*?(?:</(?P=raw)\s*+>|\Z)"
    rf"|<(?P<tag>/?[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>{_ATTRIBUTES})>|</?[a-zA-Z][^>]*+>|<[!?/][^>]*+>?|(?P<text>[^<]++|<)",
    re.S | re.I,
)
#: The same where no tag is closed any more: nothing can be searched for in vain, at every "<", to the end of the page.
_TAIL = re.compile(r"<[!?/].*+|(?P<text>[^<]++|<)(?P<tag>)(?P<rest>)", re.S)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_MAIN_ROLE = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


def marks(rest: str, in_article: bool) -> set[str]:
    """The words of NOT_ARTICLE that mark an element by its class, id and role."""
    out: set[str] = set()
    for m in _NAMED.finditer(rest):
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = {p.lower() for p in _PART.findall(name)}
            if parts & QUALIFIERS:
                continue
            found = parts & NOT_ARTICLE
            out |= found - {"header"} if in_article or parts & HEADED else found
    return out


@dataclass
class Element:
    """An element of the stack. ``mark``: empty, ``layout`` or ``closed``; ``words``: those outside links, within it."""

    name: str
    around: int
    mark: str
    leads: bool
    in_article: bool
    words: int = 0


def wrappers(elements: list[Element]) -> set[int]:
    """The marked elements that hold the content and are therefore no reason to leave it out."""
    for e in reversed(elements):
        if e.around >= 0:
            elements[e.around].words += e.words

    closed, inside = [False] * len(elements), [False] * len(elements)
    for k, e in enumerate(elements):
        closed[k] = e.mark == "closed" or (e.around >= 0 and closed[e.around])
    leading = [k for k, e in enumerate(elements) if e.leads and not e.in_article and e.words]
    # A main element leads before an article, and an article outside reader comments and the like before one inside.
    lead = max(leading, key=lambda k: (elements[k].name != "article", elements[k].name != "article" or not closed[k], elements[k].words), default=-1)
    for k, e in enumerate(elements):
        inside[k] = lead < 0 or k == lead or (e.around >= 0 and inside[e.around])
    total = elements[max(lead, 0)].words
    most = {k for k, e in enumerate(elements) if e.mark and inside[k] and 0 < total <= 2 * e.words}
    holds = {k for k in most if elements[k].mark == "layout"}
    while lead >= 0:
        holds.add(lead)
        lead = elements[lead].around
    return holds if _words_left(elements, holds) else holds | most


def _words_left(elements: list[Element], holds: set[int]) -> int:
    """Words outside links in elements that are not left out; ``words`` are totals."""
    own = [e.words for e in elements]
    for e in elements:
        if e.around >= 0:
            own[e.around] -= e.words
    out = [False] * len(elements)
    for k, e in enumerate(elements):
        out[k] = (e.around >= 0 and out[e.around]) or (bool(e.mark) and k not in holds)
    return sum(n for n, o in zip(own, out, strict=True) if not o)


def parse(page: str) -> tuple[list[tuple[str, str, bool, int]], dict[int, int]]:
    """(kind, value, skipped, section) of every token: kind ``open``, ``close`` or ``text``; and the section around each section.

    ``section`` numbers the innermost sectioning element by the index of its opening token (-1: none)."""
    out: list[tuple[str, str, int, int]] = []  # with the element in the place of skipped
    around: dict[int, int] = {}
    # The first element is the page.
    elements = [Element("", -1, "", False, False)]
    stack: list[tuple[str, int, int]] = []  # name, element, section
    link = -1  # the depth of the stack at which a link opened
    opened: Counter[str] = Counter()  # how often each name is on the stack

    def cut(k: int) -> None:
        opened.subtract([e[0] for e in stack[k:]])
        del stack[k:]

    for m in _tokens(page):
        inner, section = (stack[-1][1], stack[-1][2]) if stack else (0, -1)
        if m["text"] is not None:
            out.append(("text", m["text"], inner, section))
            if link < 0:
                elements[inner].words += len(m["text"].split())
            continue
        if not m["tag"]:
            continue
        name = m["tag"].lower()
        if name.startswith("/"):
            name = name[1:]
            if opened[name] > 0:
                cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            if name == "a" or len(stack) < link:
                link = -1
            out.append(("close", name, inner, section))
            continue
        named = "=" in m["rest"]
        in_article = elements[inner].in_article or elements[inner].leads
        found = marks(m["rest"], in_article) if named else set()
        leads = name in ("article", "main") or (named and bool(_MAIN_ROLE.search(m["rest"])))
        mark = ""
        if name in SKIPPED or (name == "header" and not in_article):
            mark = "layout" if name in WRAPPERS and not found - LAYOUT else "closed"
        elif found and name not in ("html", "body", "article", "main") and not leads:
            mark = "layout" if found <= LAYOUT else "closed"
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            if opened[name] > 0 and (k := _open_before(stack, name)) >= 0:
                cut(k)
            inner, section = (stack[-1][1], stack[-1][2]) if stack else (0, -1)
            if len(stack) < link:
                link = -1
        own = section
        if name in SECTIONS:
            own = len(out)
            around[own] = section
        elements.append(Element(name, inner, mark, leads and not (found - LAYOUT), elements[inner].in_article or elements[inner].leads))
        out.append(("open", name, len(elements) - 1, own))
        if name == "a":
            link = len(stack)
        if name not in VOID and (name in BLOCKS or name in SECTIONS or name in CELLS or mark) and not m["rest"].endswith("/"):
            stack.append((name, len(elements) - 1, own))
            opened[name] += 1
    holds = wrappers(elements)
    skipped = [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        skipped[k] = skipped[e.around] or (bool(e.mark) and k not in holds)
    return [(kind, value, skipped[e], s) for kind, value, e, s in out], around


def _tokens(page: str) -> Iterator[re.Match]:
    last, end = page.rfind(">") + 1, 0
    for m in _TOKEN.finditer(page):
        if m.start() >= last and m["text"] is None:  # a comment or the like that is not closed
            return
        if m.start() >= last:
            break
        yield m
        end = m.end()
    yield from _TAIL.finditer(page, end)


def _open_before(stack: list[tuple[str, int, int]], name: str) -> int:
    """The place of an element that the next one of its kind ends, if none but its own kind's containers lie between, else -1."""
    stops = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",)}.get(name, SECTIONS)
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == name:
            return k
        if stack[k][0] in stops or stack[k][0] in SECTIONS or stack[k][0] in SKIPPED or stack[k][0] in ("ul", "ol", "table", "dl", "blockquote", "header"):
            return -1
    return -1


def count_tokens(page: str) -> tuple[Counter, Counter]:
    """How often each kind of token stands in the article of a page and outside: ``word`` or the name of a tag."""
    inside, outside = Counter(), Counter()
    depth = 0
    for kind, value, skipped, _ in parse(page or "")[0]:
        if kind == "open" and value in ("article", "main"):
            depth += 1
        count = inside if depth and not skipped else outside
        if kind == "text":
            count["word"] += len(value.split())
        elif value not in ("article", "main", "html", "body", "head"):
            count[value] += 1
        if kind == "close" and value in ("article", "main"):
            depth = max(0, depth - 1)
    return inside, outside


def weights_of(inside: Counter, outside: Counter) -> dict[str, float]:
    """Weights by kind of token: ``word`` above zero, each tag below."""
    n_in, n_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    odds = {k: math.log((inside[k] + 0.5) / n_in) - math.log((outside[k] + 0.5) / n_out) for k in {*inside, *outside}}
    weights = {k: min(-0.05, max(-3.0, w)) for k, w in odds.items() if k != "word"}
    return {"word": max(0.5, min(2.0, odds.get("word", 1.0)))} | weights


def learn(pages: list[str]) -> dict[str, float]:
    """The weights from a few pages."""
    total = (Counter(), Counter())
    for page in pages:
        for t, found in zip(total, count_tokens(page), strict=True):
            t.update(found)
    return weights_of(*total)


def learn_from_table(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """The weights, from the pages (html) that mark their article; of more than ``sample_pages`` those with the smallest hashes."""
    marked = pages.where(F.lower("html").rlike("<(article|main)[ >]")).select("html", F.xxhash64("html").alias("order"))
    least = [r[0] for r in marked.select("order").distinct().orderBy("order").limit(sample_pages).collect()]
    chosen = marked.where(F.col("order") <= max(least, default=0)).dropDuplicates(["order"])  # equal pages count once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch["html"]:
                for total, found in zip((inside, outside), count_tokens(page.as_py()), strict=True):
                    total.update(found)
        for place, found in (("inside", inside), ("outside", outside)):
            yield pa.RecordBatch.from_pydict({"place": pa.array([place] * len(found), pa.string()), "token": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    rows = chosen.select("html").mapInArrow(run, "place string, token string, n bigint").groupBy("place", "token").agg(F.sum("n").alias("n")).collect()
    return weights_of(*[Counter({r["token"]: r["n"] for r in rows if r["place"] == p}) for p in ("inside", "outside")])


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 index of the contiguous stretch with the largest total; the first of equals; (0, 0) if none is above zero."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of a page."""
    tokens, around = parse(page or "")
    words = [len(t[1].split()) if t[0] == "text" and not t[2] else 0 for t in tokens]
    scores = [w * weights["word"] if t[0] == "text" else (0.0 if t[2] else weights.get(t[1], -0.5)) for t, w in zip(tokens, words, strict=True)]
    a, b = best_stretch(scores)
    if a == b:
        return ""

    # The innermost sectioning element around all words of the stretch: of those that its tokens are in, and those that its sections open in, the least deep one.
    depth = {-1: 0}
    for section, outer in around.items():  # an outer section comes before those in it
        depth[section] = depth[outer] + 1
    held = [i for i in range(a, b) if words[i]]
    root = tokens[held[0]][3]
    for i in range(held[0], held[-1] + 1):
        kind, _, _, section = tokens[i]
        if i in around:
            section = around[i]
        elif kind != "text":
            continue
        if depth[section] < depth[root]:
            root = section
    if root >= 0 and tokens[root][1] not in ("html", "body"):
        inside: dict[int, bool] = {-1: False}
        for section, outer in around.items():
            inside[section] = section == root or inside[outer]
        picked = [i for i, t in enumerate(tokens) if inside[t[3]]]
    else:
        picked = list(range(a, b))
    blocks, line = [], []
    for i in picked:
        kind, value, skipped, _ = tokens[i]
        if kind == "text":
            if not skipped:
                line.append(value)
        elif value in BLOCKS:
            blocks.append("".join(line))
            line = []
        elif value in CELLS:
            line.append(" ")
    blocks.append("".join(line))
    return "\n".join(t for t in (" ".join(html_lib.unescape(b).split()) for b in blocks) if t)


def main_text(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url and text (the main text, never null) of every page."""
    pages = pages.select("page_id", "url", "html")
    weights = learn_from_table(pages, sample_pages)
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array([extract(h.as_py(), weights) for h in batch["html"]], pa.string())], names=["page_id", "url", "text"])

    return pages.mapInArrow(run, f"page_id {id_type}, url string, text string")
