"""Main text of web pages by the line-block distribution.

Markup is stripped into lines, one for each block of text; the bounds of containers
stay as empty lines, and what menus, adverts, forms and the like hold becomes a gap
of them.  Text lengths (in lists without link text) are summed over sliding windows
of lines.  Where the sums surge from zero a stretch of text begins, where they dive
to zero it ends, and the lines between are kept if the stretch is dense.

What the distribution finds is then completed: sparse lines stay that stand in the
same element as dense text, or between dense stretches of one parent, so that an
advert in the middle of an article doesn't cost the lines behind it.  If dense text
stands in an element that marks an article, the main text is that article, whole.
On a page too short to have dense text, lines of a marked article count alone.

Defined cases: null or empty html gives the empty text; a page cut off in the
middle of a tag or element is read as far as it goes; character references
without a meaning stay as they are; repeated pages give equal rows; an empty table
gives an empty result; ties don't arise, all stretches that are dense enough stay;
extra columns don't enter the plan; pages of any length are read whole, in one pass
whose time grows with the length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Lines in a sliding window.
WINDOW = 3
#: Characters that the fullest window of a dense stretch holds at least.
DENSE = 120
#: Empty lines for a bound of a container.
BOUND = 2

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|$)|<[!?/][^>]*(?:>|$)|[^<]+|<""", re.S)
_ATTR = re.compile(r"""([a-zA-Z][a-zA-Z0-9:_-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea select option title".split())
#: Elements that hold no main text.
DROPPED = RAW | frozenset("head nav footer aside form button dialog menu label input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th".split())
#: Elements that belong to the text of the element they stand in.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr caption figure figcaption".split())
#: Of these, the ones whose link text counts: a title or paragraph may be a link.
LINKED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote figcaption caption".split())
#: Elements that are the page as a whole.
ROOT = frozenset("html body".split())
#: Words of class and id names that mark what surrounds the main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus"
    " footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promoted related"
    " share sharing sidebar sidebars signup social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Words before a mark in a name that tell how a page is laid out around it.
LAYOUT = frozenset("with without has no".split())
#: Last words of names that hold main text, and first words of the names of its parts.
CONTENT, OWN = frozenset("content article main body".split()), frozenset("entry post article story".split())
#: What "related" boxes list.
LISTED = frozenset("articles content items links list news posts stories topics".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)}


def _drops(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    if tag in ("html", "body", "article", "main"):
        return bool(tag == "article" and {"comment", "comments"} & {w.lower() for w in _WORDS.findall(attrs.get("class", ""))})
    names = f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('itemprop', '')}".split()
    whole, part, content = False, False, False
    for words in ([w.lower() for w in _WORDS.findall(name)] for name in names):
        marks = [k for k, w in enumerate(words) if w in MARKS and not (k and words[k - 1] in LAYOUT)]
        marks = [k for k in marks if words[k] != "related" or len(words) == 1 or words[k + 1 : k + 2] and words[k + 1] in LISTED]
        if words and words[-1] in ("header", "masthead") and (inside or words[0] in OWN):
            marks = [k for k in marks if k < len(words) - 1]  # the heading of the article itself
        whole |= bool(marks) and len(words) == 1
        part |= bool(marks)
        content |= not marks and bool(words) and words[-1] in CONTENT
    return whole or (part and not content)


def _marks_article(tag: str, attrs: dict[str, str]) -> bool:
    return tag in ("article", "main") or attrs.get("role", "").lower() == "main" or attrs.get("itemprop", "") == "articleBody"


@dataclass(frozen=True)
class Line:
    """A block of text and where it stands; elements are named by their place in
    the page, 0 is the page itself."""

    text: str = ""
    weight: int = 0
    article: int = 0  # the element that marks an article
    own: int = 0  # the innermost container
    holder: int = 0  # the container that it stands in, a container of its own aside
    parent: int = 0  # the container of the innermost one


_EMPTY = Line()


@dataclass
class _Open:
    """An element that isn't closed yet; where its text would stand."""

    tag: str
    drops: bool = False
    article: int = 0
    own: int = 0
    parent: int = 0
    block: str = ""  # the innermost element that isn't inline, if that is textual


def lines(page: str) -> list[Line]:
    """The blocks of text, with empty lines for the bounds of containers and for
    what was dropped."""
    out: list[Line] = []
    parts: list[str] = []
    page_itself = _Open("")
    stack: list[_Open] = []
    opened: Counter[str] = Counter()
    dropped = links = linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                at = stack[-1] if stack else page_itself
                weight = len(text) if at.block in LINKED else len(text) - min(linked, len(text))
                out.append(Line(text, weight, at.article, at.own, at.own if at.block else at.parent, at.parent))
            parts.clear()
        linked = 0

    def bound(tag: str, drops: bool, marks: bool) -> None:
        """An element begins or ends."""
        if tag in INLINE and not drops:
            return
        flush()
        out.extend([_EMPTY] * (WINDOW if drops or marks else 0 if tag in TEXTUAL or tag in ROOT else BOUND))

    def pop() -> str:
        nonlocal dropped, links
        x = stack[-1]
        marks = x.article > (stack[-2].article if len(stack) > 1 else 0)
        if not dropped:
            bound(x.tag, False, marks)
        stack.pop()
        opened[x.tag] -= 1
        dropped -= x.drops
        links -= x.tag == "a"
        return x.tag

    end = len(page)
    at = 0
    while at < end:
        m = _TOKEN.match(page, at)
        if m is None:
            break
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if not dropped and not m[0].startswith(("<!", "<?", "</")):
                parts.append(m[0])
                linked += len(m[0]) if links else 0
            continue
        tag = tag.lower()
        if m[1] or m[4]:  # an end tag
            if not opened[tag] and tag not in INLINE and not dropped:
                flush()
            while opened[tag] and pop() != tag:
                pass
            continue
        if tag in VOID:
            if not dropped:
                parts.append(" ") if tag == "br" else None
                if tag == "hr":
                    flush()
            continue
        attrs = _attributes(m[3] or m[6] or "")
        if tag in ("p", "li", "option", "tr", "dt", "dd") and stack and stack[-1].tag == tag:
            pop()
        over = stack[-1] if stack else page_itself
        drops = _drops(tag, attrs, over.article > 0)
        marks = not dropped and not drops and _marks_article(tag, attrs)
        if tag in RAW:  # nothing stands there, so no gap
            if not dropped and tag not in INLINE:
                flush()
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if not dropped:
            bound(tag, drops, marks)
            if tag in ("td", "th"):
                parts.append(" ")
        x = _Open(tag, drops, at if marks else over.article, over.own, over.parent, over.block)
        if tag in TEXTUAL:
            x.block = tag
        elif tag not in INLINE and tag not in ROOT:
            x.own, x.parent, x.block = at, over.own, ""
        stack.append(x)
        opened[tag] += 1
        dropped += drops
        links += tag == "a"
    if not dropped:
        flush()
    return out


def stretches(weights: list[int]) -> list[tuple[int, int, int]]:
    """(first line, line behind the last, fullest window) of each stretch, from a
    surge of the window sums to their dive."""
    n, out, i = len(weights), [], 0
    sums = [sum(weights[i : i + WINDOW]) for i in range(n)]
    while i < n:
        if not sums[i]:
            i += 1
            continue
        start = i
        while not weights[start]:  # the surge: the window's first line with text
            start += 1
        stop = i
        while stop < n and sums[stop]:
            stop += 1
        last = stop - 1  # the dive: from here on the windows are empty
        while not weights[last]:
            last -= 1
        out.append((start, last + 1, max(sums[i:stop])))
        i = stop
    return out


def extract(page: str | None) -> str:
    """The main text: blocks in page order, joined by two line ends."""
    found = lines(page) if page else []
    weights = [x.weight for x in found]
    if not any(weights):  # a page of links has no other text
        weights = [len(x.text) for x in found]
    if max((s for *_, s in stretches(weights)), default=0) < DENSE and any(x.article and w for x, w in zip(found, weights, strict=True)):
        weights = [w if x.article else 0 for x, w in zip(found, weights, strict=True)]
    runs = stretches(weights)
    floor = min(DENSE, max((s for *_, s in runs), default=0))
    dense = [k for k, (_, _, s) in enumerate(runs) if s >= floor]
    spans = {k: [i for i in range(*runs[k][:2]) if weights[i]] for k in range(len(runs))}
    articles = {found[i].article for k in dense for i in spans[k]} - {0}
    if articles:
        inside = [i for i, x in enumerate(found) if x.article in articles]
        first = {a: min(i for i in inside if found[i].article == a and weights[i]) for a in articles}
        last = {a: max(i for i in inside if found[i].article == a and weights[i]) for a in articles}
        return "\n\n".join(found[i].text for i in inside if found[i].text and first[found[i].article] <= i <= last[found[i].article])
    held: Counter[int] = Counter()  # characters that dense stretches have in each element
    around: dict[int, list[int]] = {}  # the dense stretches below a parent
    for k in dense:
        for i in spans[k]:
            held.update({e: weights[i] for e in {found[i].own, found[i].holder}})
            if found[i].parent:
                around.setdefault(found[i].parent, []).append(k)
    keep = []
    for k, (a, b, s) in enumerate(runs):
        if s < floor:  # from the first to the last line that stands with dense text
            near = [i for i in spans[k] if held[found[i].own] >= floor or held[found[i].holder] >= floor or (p := around.get(found[i].parent)) and p[0] < k < p[-1]]
            a, b = (near[0], near[-1] + 1) if near else (a, a)
        keep += [found[i].text for i in range(a, b) if found[i].text]
    return "\n\n".join(keep)


def _extracted(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.schema.get_field_index(column)
        texts = [extract(v) for v in batch.column(k).to_pylist()]
        rest = [i for i in range(batch.num_columns) if i != k]
        names = [batch.schema.names[i] for i in rest] + ["text", "n_chars"]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)


def extract_pages(pages: DataFrame, html_column: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keys`` with the main text and its length in code points."""
    out = T.StructType([*[pages.schema[k] for k in keys], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*keys, F.col(html_column)).mapInArrow(lambda it: _extracted(it, html_column), out)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
