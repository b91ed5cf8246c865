"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element, and a line weighs the characters it has outside links.
Menus, notices and other named boilerplate become blank lines. The weights are summed over windows of WIDTH
lines: text begins where the sum surges over a threshold and ends where it dives to nothing. Lines between
are kept, short ones and links among them too. This runs over all lines of every page. An article or main element
whose text reaches the threshold extends what was found to its own ends; text outside of it has to surge by itself.
Boilerplate between two blocks of one container ends nothing, and a container whose own blocks reach the threshold
has all of them, from the first to the last.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from balanza.llm import words as W

WIDTH = 3
THRESHOLD = 86

# Element names and words of class, id and role names that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SCOPES = frozenset("article aside blockquote body details div fieldset figure footer form header main nav ol section table ul".split())
CONTAINERS = frozenset("article div main section td".split())
ENDED_BY_SELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
DROPPED = frozenset(
    "aside button canvas dialog footer head iframe input label menu nav noembed noframes noscript object script search select style svg template textarea title xmp".split()
)
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination "
    "popup promo promotion promoted recommended related reply replies respond share sharing sidebar signup skip social sponsor sponsored sponsors "
    "subscribe subscription toolbar topbar widget widgets".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
KEPT_WITH = frozenset("article content entry main post story".split())
READERS = frozenset("comment comments disqus reply replies respond".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3".split())
#: A form, or an element that its name marks, is text after all if it has so many times the threshold outside links:
#: two, and one more for each field, for a form; ten, and half of the page, for a name.
FORM_TEXT, NAMED_TEXT = 2, 10

_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)} if text.strip(" /") else {}


def _boilerplate(tag: str, attributes: dict[str, str], inside: bool) -> str:
    """Why an element's text is left out: ``kind`` of element, ``name`` of class or id, or empty if it is not.

    ``inside``: within an article or main element.
    """
    if tag in DROPPED or tag == "header" and not inside:
        return "kind"
    if tag in ("html", "body", "main") or not attributes:
        return ""
    if "hidden" in attributes or attributes.get("role", "").lower() in ROLES and tag != "form" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return "kind"
    names = [{p.lower() for p in _PART.findall(name)} for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()]
    every = frozenset().union(*names)
    for parts in names:
        hit = parts & NAMES
        if tag == "article" and every & KEPT_WITH:
            hit &= READERS  # its topics are no boilerplate
        if hit and not (hit <= {"header"} and (inside or parts & KEPT_WITH)) and not (hit <= {"comment", "comments"} and {"no"} & parts):
            return "name"
    return ""


def _tags(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text): kind is text, open or close; comments, doctypes and raw text are passed over."""
    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            yield "text", "", page[at:]
            return
        if mark > at:
            yield "text", "", page[at:mark]
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = size if end < 0 else end + 3
            continue
        closing = page.startswith("</", mark)
        name = _NAME.match(page, mark + 1 + closing)
        if not name:
            if page[mark + 1 : mark + 2] in ("!", "?", "/"):
                end = page.find(">", mark)
                at = size if end < 0 else end + 1
            else:
                yield "text", "", "<"
                at = mark + 1
            continue
        end = page.find(">", name.end())
        if end < 0:
            return
        body = page[name.end() : end]
        for quote in "\"'":  # a > inside a quoted value
            if body.count(quote) % 2:
                close = page.find(quote, end)
                more = page.find(">", close) if close > 0 else -1
                if more > 0 and "<" not in page[end:close]:
                    end = more
                    body = page[name.end() : end]
        tag = name[0].lower()
        at = end + 1
        yield ("close" if closing else "open"), tag, body
        if not closing and tag in RAW:
            found = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            at = found.start() if found else size


def lines_of(page: str) -> list[tuple[str, int, int, int, bool]]:
    """(text, weight, number of the outermost article or main or 0, number of the container or 0, heading) of each line.

    Boilerplate outside articles and their own ends leave blank lines, but not within a container's own blocks. A
    container without blocks inside is itself a block of the one around it. What forms hold is judged when they
    end, and what names mark, when the page ends.
    """
    return _judged(page, frozenset())


def _judged(page: str, spared: frozenset) -> list[tuple[str, int, int, int, bool]]:
    """``spared``: places of elements that their names don't mark."""
    lines: list[tuple] = []
    stack: list[tuple] = []  # tag, left out, article, within link, container, place
    named: dict[int, int] = {}  # weight of what a name leaves out, by the element's place
    forms: list[list[int]] = []  # of each open form: lines before it, fields, the article it is in
    place = weighed = hushed = 0  # hushed: the outermost element that a name leaves out
    around, filled = [0], [True]  # of each container: the one it is in, whether it has blocks
    parts: list[str] = []
    linked = articles = 0
    heading = False

    def flush(inside: int, box: int) -> None:
        nonlocal parts, linked, weighed
        text = " ".join("".join(parts).split())
        if text:
            if lines and lines[-1][0] and bool(lines[-1][2]) != bool(inside):
                lines.extend([("", 0, 0, 0, False)] * WIDTH)
            weight = max(0, len(text) - linked)
            weighed += weight
            lines.append((text, weight, inside, box, heading))
        parts, linked = [], 0

    def top() -> tuple:
        return stack[-1] if stack else ("", False, 0, False, 0, 0)

    def cut(i: int) -> None:
        """Elements from the i-th on end; a form with little text for its fields leaves nothing."""
        nonlocal hushed
        for tag, out, _, _, _, at in reversed(stack[i:]):
            if at == hushed:
                hushed = 0
            if tag == "form" and not out and forms:
                begin, fields, scope = forms.pop()
                held = sum(line[1] for line in lines[begin:])
                if held < THRESHOLD * (FORM_TEXT + fields) and not any(line[2] and line[2] != scope for line in lines[begin:]):
                    lines[begin:] = [("", 0, 0, 0, False)] * (0 if scope else WIDTH)
        del stack[i:]

    def pop_to(tag: str, until: frozenset | tuple) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                cut(i)
                return
            if stack[i][0] in until:
                return

    for kind, tag, text in _tags(page):
        _, out, inside, link, box, _ = top()
        if kind == "text":
            if not out:
                plain = html.unescape(text)
                parts.append(plain)
                if link:
                    linked += len(" ".join(plain.split()))
            elif hushed and not link and stack[-1][0] not in DROPPED:
                named[hushed] += len(" ".join(html.unescape(text).split()))
            continue
        if tag in BLOCKS:
            flush(inside, box)
            heading = tag in HEADINGS and kind == "open"
        elif tag == "br":
            parts.append(" ")
        if kind == "close":
            pop_to(tag, () if tag in SCOPES else SCOPES)
            continue
        place += 1
        if (tag in BLOCKS and tag != "head" or tag == "body") and tag not in HEAD_ONLY:
            pop_to("head", ("body", "noscript", "template"))  # it may end without saying so
        if tag in BLOCKS:
            pop_to("p", SCOPES)
            if tag in ENDED_BY_SELF:
                pop_to(tag, ENDED_BY_SELF[tag])
        if tag in ("input", "textarea", "select") and forms:  # what is typed or chosen
            hidden = tag == "input" and re.search(r"""type\s*=\s*["']?(hidden|submit|button)""", text, re.IGNORECASE)
            forms[-1][1] += 0 if hidden else 1
        if tag in VOID:
            continue
        _, out, inside, link, box, _ = top()
        why = "" if out else _boilerplate(tag, _attributes(text), inside)
        if why == "name" and place in spared:
            why = ""
        drop = bool(out or why)
        if why == "name":
            hushed, named[place] = place, 0
        if why:
            if tag not in ("button", "input", "label", "script", "style", "noscript", "template", "iframe", "svg", "canvas", "object"):
                flush(inside, box)
                if not inside:
                    lines.extend([("", 0, 0, 0, False)] * WIDTH)
        if not drop and not inside and tag in ("article", "main"):
            articles += 1
            inside = articles
        if not drop and tag in BLOCKS and tag not in ("html", "body"):
            filled[box] = True
            if tag in CONTAINERS:
                around.append(box)
                filled.append(tag in ("article", "main"))
                box = len(around) - 1
        if tag == "form" and not drop:
            forms.append([len(lines), 0, inside])
        stack.append((tag, drop, inside, link or tag == "a", box, place))
    flush(top()[2], top()[4])
    cut(0)
    # a name on what holds most of the page is no verdict on it
    large = frozenset(at for at, weight in named.items() if weight >= NAMED_TEXT * THRESHOLD and 2 * weight > weighed + weight)
    if large - spared:
        return _judged(page, spared | large)
    out_lines: list[tuple] = []
    blanks, last = 0, -1
    for text, weight, inside, box, head in lines:
        if not text:
            blanks += 1
            continue
        own = box if filled[box] else around[box]
        if own != last:
            out_lines.extend([("", 0, 0, 0, False)] * blanks)
        out_lines.append((text, weight, inside, own, head))
        blanks, last = 0, own
    return out_lines


def spans(weights: np.ndarray, threshold: float, width: int = WIDTH) -> list[tuple[int, int]]:
    """Line ranges from a surge to a dive of the sums over ``width`` lines."""
    if not len(weights):
        return []
    sums = np.convolve(weights, np.ones(width), mode="full")[width - 1 :]  # sum of lines i … i + width - 1
    limit = min(threshold, float(sums.max()))
    out, i, n = [], 0, len(weights)
    while i < n:
        if sums[i] <= 0 or sums[i] < limit:
            i += 1
            continue
        j = i
        while j < n and sums[j] > 0:
            j += 1
        held = np.flatnonzero(weights[i:j]) + i
        out.append((int(held[0]), int(held[-1]) + 1))
        i = j
    return out


def _reach(lines: list[tuple[str, int, int, int, bool]]) -> list[tuple[int, int]]:
    """The line ranges of the text: what surges, and all of an article or container that reaches the threshold, with
    the heading right before an article."""
    weights = np.array([line[1] for line in lines], dtype=float)
    scope = np.array([line[2] for line in lines], dtype=np.int64)
    boxes = np.array([line[3] for line in lines], dtype=np.int64)
    if not weights.any():  # an article of links alone
        weights = np.array([len(line[0]) if line[2] else 0 for line in lines], dtype=float)
    found = spans(weights, THRESHOLD)
    if not found:
        return []
    limit = min(THRESHOLD, float(np.convolve(weights, np.ones(WIDTH)).max()))
    totals = np.bincount(scope, weights=weights)
    numbers, first = np.unique(scope, return_index=True)
    last = len(scope) - np.unique(scope[::-1], return_index=True)[1]
    found += [(headed(lines, int(a)), int(b)) for number, a, b in zip(numbers, first, last) if number and totals[number] >= limit]
    held = np.flatnonzero(weights)
    ends = {}
    for i in held.tolist():
        ends[int(boxes[i])] = (ends.get(int(boxes[i]), (i, i))[0], i + 1)
    for a, b in found.copy():
        here, at = np.unique(boxes[a:b], return_inverse=True)
        found += [ends[int(box)] for box, size in zip(here, np.bincount(at, weights=weights[a:b])) if box and size >= limit]
    return merged(found)


def headed(lines: list[tuple[str, int, int, int, bool]], at: int) -> int:
    """The first line of what begins at ``at``, with headings right before it."""
    i = at
    while i > 0:
        i -= 1
        if lines[i][0]:
            if not lines[i][4] or lines[i][2]:
                break
            at = i
    return at


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of line ranges, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def main_text(page: str) -> str:
    """The text of a page's article, blocks joined by line feeds; empty if there is none."""
    lines = lines_of(page)
    return "\n".join(line[0] for a, b in _reach(lines) for line in lines[a:b] if line[0])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in W.slices(batch, "html"):
            texts = [main_text(page or "") for page in rows.column("html").to_pylist()]
            names = [n for n in rows.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays(
                [rows.column(n) for n in names] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"]
            )


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep`` with text and n_chars (code points) for every page; ``keep`` can't name these two.

    Character references are decoded, white space inside a block becomes one blank, blocks are joined by a
    line feed. Null and empty pages and pages without text give the empty string. Broken markup is read as far
    as it goes: an unclosed element ends with its parent.
    """
    if {"text", "n_chars"} & set(keep):
        raise ValueError("text and n_chars are what is returned; rename such columns before")
    names = {f"k{i}": c for i, c in enumerate(keep)}
    source = pages.select(*[F.col(c).alias(k) for k, c in names.items()], F.col(html_col).alias("html"))
    schema = ", ".join(f"{k} {pages.schema[c].dataType.simpleString()}" for k, c in names.items())
    found = source.mapInArrow(_extract, f"{schema}, text string, n_chars long")
    return found.select(*[F.col(k).alias(c) for k, c in names.items()], "text", "n_chars")
