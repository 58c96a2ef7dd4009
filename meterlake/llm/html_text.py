"""Main text of HTML pages by tag-path ratios.

A page is read once into blocks: runs of text between the starts and ends of block elements, each with the path of
elements above it. Paths, not single nodes, are judged: over all blocks with the same path, the characters per block (the
text ratio) and the punctuation per block (the punctuation ratio). Both are smoothed over the blocks in page order with a
Gaussian; each ratio and its smoothed one are fused as a geometric mean, the two kinds as a product, less what stands in
links. So a lone notice beside an article gains little from its neighbour. Paths above a share of the page's spread are content.

Names weigh, they don't decide. An element whose tag (menus, headers, footers, forms) or whose class, id or role (sidebars,
notices, adverts, comments of readers) hints that it is no article has its blocks' scores multiplied by ``FAINT``: long
running text in it is still content, and a page without any telling name is judged by its ratios alone. A hint doesn't
count for a heading, for an element around an article or main element, or for one with a large share of the page's text;
within an article or main element not for paragraphs and the like, and for a part of a name only if the element is mostly
links.

The main text is then what stands in the smallest element around all of the content: its other blocks belong to it as well
(a heading, a short paragraph) unless they are mostly links or hinted at. Left out beforehand are only the head, hidden
elements, and elements whose inside is no text (scripts, styles, drawings, input fields).

Scale: a map over whole pages, one at a time in memory; time grows with a page's length, also for broken pages and tags
without an end. Elements nested deeper than ``DEEPEST`` are read as siblings, as browsers do.

Defined results: a null or empty page, or one without text, gives an empty text; rows without an id are extracted as any
others, repeated rows get the same result; paths with equal scores are content together or not at all; a tag that is never
closed, or closed without being open, only affects where blocks end; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the standard.
RAW = {"script", "style", "template", "textarea", "title", "iframe", "svg", "canvas", "audio", "video", "select", "datalist", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "math", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
INLINE |= {"mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "mpadded", "mphantom", "msub", "msup", "msubsup", "munder", "mover", "munderover", "semantics"}
CLOSES_PARAGRAPH = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIST_TOPS = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "menu"}

# Words in a class, id or role that hint at what is no article.
OUTSIDE_TAGS = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu"}
OUTSIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies copyright disqus "
    "footer gdpr login masthead menu modal nav navbar navigation navigationbar newsletter notice notification pagination pager popup promo promotion related replies reply recommended "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget complementary alert".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = {"p", "blockquote", "pre", "li", "dt", "dd", "tr", "td", "th", "figure", "figcaption"}
TOPS = {"html", "body", "article", "main"}
CONTAINERS = {"article", "main", "section", "div", "body", "td", "html"}

OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[A-Za-z])")
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z]+")
MARKS = re.compile(r"[.,;:!?…](?!\S)|[。，、；：！？«»\"“”„()–—]")  # a point in a name or number is none
SPREAD, LINKED, RADIUS, FAINT = 0.5, 0.5, 1.0, 0.001
LARGE, LARGE_BESIDE = 0.5, 0.9  # shares of the page's text; the second for tags, and where an article or main element has text
DEEPEST = 512
PART, NAME, TAGGED = 1, 2, 3  # hints: a part of a name, a whole name, the tag


class _Element:
    __slots__ = ("above", "depth", "hint", "outside", "path", "tag")

    def __init__(self, tag: str, path: int, above: _Element | None, outside: bool, hint: int = 0) -> None:
        self.tag, self.path, self.above, self.outside, self.hint = tag, path, above, outside, hint
        self.depth = above.depth + 1 if above else 0


class _Block:
    __slots__ = ("element", "linked", "path", "text")

    def __init__(self, element: _Element, text: str, linked: int) -> None:
        self.element, self.path, self.text, self.linked = element, element.path, text, linked


def _within(e: _Element | None, tags: tuple[str, ...]) -> bool:
    while e:
        if e.tag in tags:
            return True
        e = e.above
    return False


def _read_attributes(tag: str, attributes: str) -> tuple[str, bool, int]:
    """The first class, whether the element is hidden, and the hint of its names."""
    label, hidden, found = "", False, 0
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden":
            hidden |= name == "hidden" or value == "true"
            continue
        if name == "class" and not label:
            label = value.split(" ")[0]
        if not OUTSIDE_WORDS.isdisjoint(WORD.findall(value)):
            found = max(found, PART if OUTSIDE_WORDS.isdisjoint(value.split()) else NAME)
    spared = tag in HEADINGS or tag in TOPS
    return label, hidden and tag not in TOPS, 0 if spared else found


def blocks(page: str) -> list[_Block]:
    """All blocks with text in page order, but for those in the head and in hidden elements."""
    top = _Element("", 0, None, False)
    stack, out, parts = [top], [], []  # parts: (text, in a link)
    paths: dict[tuple[int, str], int] = {}
    opened: Counter[str] = Counter()
    endless: set[str] = set()  # raw elements of which no more ends follow
    links = at = 0

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(p for p, _ in parts)).split())
            if text and not stack[-1].outside:
                linked = sum(len("".join(entities.unescape(p).split())) for p, inside in parts if inside)
                out.append(_Block(stack[-1], text, linked))
            parts.clear()

    def pop(until: int) -> None:
        nonlocal links
        if any(e.tag not in INLINE for e in stack[until:]):
            flush()
        for e in stack[until:]:
            links -= e.tag == "a"
            opened[e.tag] -= 1
        del stack[until:]

    while at < len(page):
        start = OPEN.search(page, at)
        begin = start.start() if start else len(page)
        if begin > at:
            parts.append((page[at:begin], links > 0))
        if not start:
            break
        kind = start[0]
        if kind == "<!--" or kind == "<![CDATA[":
            close = "-->" if kind == "<!--" else "]]>"
            end = page.find(close, start.end())
            end = end if end >= 0 else len(page)
            if kind != "<!--":
                parts.append((entities.escape(page[start.end() : end]), links > 0))
            at = end + len(close)
            continue
        if kind in ("<!", "<?"):
            end = page.find(">", begin)
            if end < 0:
                parts.append((page[begin:], links > 0))
                break
            at = end + 1
            continue
        m = TAG.match(page, begin) or LOOSE_TAG.match(page, begin)  # the second: a quote has no end
        if not m:  # no tag ends any more
            parts.append((page[begin:], links > 0))
            break
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    pop(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break  # an inline end tag doesn't close the block in which it stands
            else:
                if tag not in INLINE:
                    flush()
            continue
        if tag in RAW:
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not end:
                endless.add(tag)
            at = end.end() if end else at if m[3].rstrip().endswith("/") else len(page)
            parts.append((" ", links > 0))
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append((" ", links > 0))
            continue
        if tag not in INLINE:
            if tag in CLOSES_PARAGRAPH:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        pop(k)
                        break
                    if stack[k].tag not in INLINE:
                        break
            if tag in CLOSED_BY_SAME:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in CLOSED_BY_SAME[tag]:
                        pop(k)
                        if tag != "tr":
                            break
                    elif stack[k].tag in LIST_TOPS:
                        break
            flush()
        if m[3].endswith("/") and tag not in INLINE and tag not in CLOSES_PARAGRAPH:
            continue
        if len(stack) > DEEPEST:
            pop(DEEPEST)
        above = stack[-1]
        label, hidden, hint = _read_attributes(tag, m[3]) if m[3] else ("", False, 0)
        if tag in OUTSIDE_TAGS and not (tag == "header" and _within(above, ("article", "main"))):  # an article's own heading
            hint = TAGGED
        elif tag == "noscript":
            hint = max(hint, PART)
        # inline elements are no part of a path; an unclosed one must not hide what follows
        path = above.path if tag in INLINE else paths.setdefault((above.path, f"{tag}.{label}"), len(paths) + 1)
        stack.append(_Element(tag, path, above, above.outside or hidden or tag == "head", hint))
        links += tag == "a"
        opened[tag] += 1
    flush()
    return out


def _smoothed(values: list[float]) -> list[float]:
    reach = range(-2, 3)
    weights = [math.exp(-(d * d) / (2 * RADIUS * RADIUS)) for d in reach]
    out = []
    for i in range(len(values)):
        near = [(weights[d + 2], values[i + d]) for d in reach if 0 <= i + d < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def _sums(found: list[_Block], value: Callable[[_Block], int]) -> dict[_Element, int]:
    """The sum of a value over all blocks in each element that has some."""
    out: dict[_Element, int] = {}
    for b in found:
        e: _Element | None = b.element
        while e and e not in out:
            out[e] = 0
            e = e.above
        out[b.element] += value(b)
    for e in sorted(out, key=lambda e: -e.depth):
        if e.above:
            out[e.above] += out[e]
    return out


def _passed_down(found: list[_Block], holds: Callable[[_Element], bool]) -> list[bool]:
    """For each block whether this holds for an element around it."""
    known: dict[_Element, bool] = {}
    out = []
    for b in found:
        path, e = [], b.element
        while e and e not in known:
            path.append(e)
            e = e.above
        said = known[e] if e else False
        for e in reversed(path):
            said = known[e] = said or holds(e)
        out.append(said)
    return out


def _faint(found: list[_Block]) -> list[bool]:
    """For each block whether it is in an element whose hint counts."""
    chars, linked, holds = _sums(found, lambda b: len(b.text)), _sums(found, lambda b: b.linked), defaultdict(int)
    marked = [e for e in chars if e.tag in ("article", "main")]
    for m in marked:  # the longest article or main element in each element
        e = m.above
        while e:
            holds[e] = max(holds[e], chars[m])
            e = e.above
    longest = max([chars[e] for e in marked if e.tag == "article"] or [chars[e] for e in marked], default=0)
    total = sum(len(b.text) for b in found)

    def counts(e: _Element) -> bool:
        # comments of readers may be articles too, short ones in an element of that name
        if not e.hint or e in holds and (e.hint == PART or holds[e] >= LARGE * longest):
            return False
        up = e.above
        while up and up.tag != "article" and (up.tag != "main" or up in holds):
            up = up.above
        if up:
            return e.tag not in PROSE and (e.hint >= NAME and chars[e] < LARGE * chars[up] or linked[e] >= LINKED * chars[e])
        return chars[e] < (LARGE_BESIDE if marked or e.hint == TAGGED else LARGE) * total

    return _passed_down(found, counts)


def scores(found: list[_Block], faint: list[bool]) -> list[float]:
    """The fused ratio of each block's path."""
    chars, marks, linked, count, total = (defaultdict(float) for _ in range(5))
    for b in found:
        chars[b.path] += len(b.text)
        marks[b.path] += len(MARKS.findall(b.text))
        linked[b.path] += b.linked
        count[b.path] += 1
    text, points = [chars[b.path] / count[b.path] for b in found], [marks[b.path] / count[b.path] + 0.1 for b in found]
    near = zip(_smoothed(text), _smoothed(points))
    for t, p, (smooth_t, smooth_p), b, f in zip(text, points, near, found, faint):
        total[b.path] += math.sqrt(t * smooth_t * p * smooth_p) * max(0.0, 1 - linked[b.path] / chars[b.path]) * (FAINT if f else 1.0)
    return [total[b.path] / count[b.path] for b in found]


def content(found: list[_Block]) -> list[_Block]:
    """The blocks that are the main text."""
    if not found:
        return []
    faint = _faint(found)
    fused = scores(found, faint)
    mean = sum(fused) / len(fused)
    spread = math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    picked = {id(b) for b, f in zip(found, fused) if f >= max(SPREAD * spread, 1e-9)} or {id(b) for b, f in zip(found, faint) if not f}
    if not picked:
        return []
    # the smallest element that holds all of the chosen text
    inside = _sums([b for b in found if id(b) in picked], lambda b: 1)
    around = next(b for b in found if id(b) in picked).element
    while inside[around] < len(picked) or around.tag and around.tag not in CONTAINERS:
        around = around.above
    e = around
    while e:  # an article or main element around it is the better bound
        if e.tag in ("article", "main"):
            around = e
            break
        e = e.above

    held = _passed_down(found, lambda e: e is around)
    return [b for b, f, h in zip(found, faint, held) if h and (id(b) in picked or not f and b.linked < LINKED * len(b.text))]


def main_text(page: str) -> str:
    return "\n".join(b.text for b in content(blocks(page)))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and its length in code points for every row."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "") for p in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
