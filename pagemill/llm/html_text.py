"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one per block with text. A line's length is that of its text outside links; it is zero in
boilerplate elements and, where a page has an article element, outside that. Lengths are summed over a sliding window of
lines: where the sums rise above a threshold is a surge, where they fall to it a dive, and the lines from each surge to
the next dive are kept. So a list of links as long as the window parts the text and goes, a lone link stays.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window, and the characters of text up to which a window counts as empty.
WINDOW, LEAST = 3, 0
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*/>|<(script|style|noscript|template|svg|iframe|textarea|select)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?](?:[^>]*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|([^<]+|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Elements that are never main text, elements that run on in their line, and the words by which a
#: class, id or role marks boilerplate.
DROPPED = frozenset("head title nav footer aside form button menu dialog fieldset label input option".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments reply replies discussion disqus respond social "
    "share sharing related recommended popup modal overlay newsletter subscribe subscription signup login search widget pagination pager toolbar "
    "complementary contentinfo skip".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset(("article", "main"))
#: Fixed values of the format: elements without a required end tag and the start tags that end them; where the search
#: for an open element stops.
_OPTIONAL = frozenset("p li dt dd td th tr thead tbody tfoot caption colgroup option optgroup body html".split())
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li "
    "main menu nav ol p pre search section summary table ul".split()
)
_CELLS = frozenset(("td", "th", "caption"))
_ROWS = _CELLS | {"tr"}
_BODIES = _ROWS | {"thead", "tbody", "tfoot", "colgroup"}
_STARTS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": _CELLS, "th": _CELLS, "tr": _ROWS, "option": {"option"}, "optgroup": {"option", "optgroup"}} | dict.fromkeys(("thead", "tbody", "tfoot"), _BODIES)
_LISTS = frozenset(("ul", "ol", "menu", "dir", "dl", "table", *_CELLS, *_MAIN, "section", "aside", "nav", "select"))
_SCOPE = frozenset(("table", *_CELLS, "button", "object"))


def _marked(attributes: str) -> bool:
    return any(w.lower() in MARKS for value in _NAMES.findall(attributes) for w in _WORDS.findall(value))


def _ends(tokens: list[tuple[str, bool]]) -> dict[int, tuple[int, bool]]:
    """For each start tag of (name, is an end tag): the tag that ends its element, and whether the page may end it so.

    An element ends at its own end tag, at that of an element around it, or at a start tag that implies its end; an
    element whose end tag is required but missing isn't closed properly.
    """
    out: dict[int, tuple[int, bool]] = {}
    stack: list[tuple[str, int]] = []

    def close(depth: int, at: int, own: bool = False) -> None:
        for k, (name, start) in enumerate(stack[depth:]):
            out[start] = (at, name in _OPTIONAL or (own and not k))
        del stack[depth:]

    def find(names, stops) -> int:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in stops:
                return -1
        return -1

    for at, (name, end) in enumerate(tokens):
        if name in _VOID:
            if name == "hr" and (k := find(("p",), _SCOPE)) >= 0:
                close(k, at)
        elif end:
            if name in INLINE:
                k = len(stack) - 1
                while k >= 0 and stack[k][0] != name and stack[k][0] in INLINE:
                    k -= 1
                if k >= 0 and stack[k][0] == name:
                    out[stack[k][1]] = (at, True)
                    del stack[k]
            elif (k := find((name,), () if name in _MAIN or name in ("body", "html") else ("table",) if name in _BODIES or name == "table" else _SCOPE)) >= 0:
                close(k, at, True)
        else:
            if name in _STARTS and (k := find(_STARTS[name], _LISTS - _STARTS[name])) >= 0:
                # the outermost that this tag ends: a row ends its cell too
                while k and stack[k - 1][0] in _STARTS[name]:
                    k -= 1
                close(k, at)
            if name in _ENDS_P and (k := find(("p",), _SCOPE)) >= 0:
                close(k, at)
            stack.append((name, at))
    close(0, len(tokens))
    return out


def lines(page: str) -> list[tuple[str, int]]:
    """(text, length) of each block with text, in page order; the text of boilerplate is empty.

    A dropped element is skipped to its end; one that isn't closed properly only to the next block's tag. A dropped
    element around the article doesn't swallow it.
    """
    out: list[tuple[str, int, bool]] = []
    held: list[str] = []
    linked = main = 0
    in_link = skipped = False
    tokens = [m for m in _TOKEN.finditer(page) if m.group(5) is not None or m.group(3) is not None]
    tags = [(m.group(3).lower(), bool(m.group(2))) for m in tokens if m.group(3) is not None]
    ends = _ends(tags)

    def end_line() -> None:
        nonlocal linked, skipped
        text = " ".join(html.unescape("".join(held)).split())
        if text or skipped:
            out.append((text, max(0, len(text) - linked), main > 0))
        held.clear()
        linked, skipped = 0, False

    tag, until = -1, -1  # until: the number of the tag at which a skipped element ends
    for m in tokens:
        text = m.group(5)
        if text is not None:
            if tag >= until:
                held.append(text)
                linked += len(" ".join(html.unescape(text).split())) if in_link else 0
            else:
                skipped = skipped or not text.isspace()
            continue
        tag += 1
        name, end = tags[tag]
        if name not in INLINE:
            end_line()
        if tag < until:
            if name not in _MAIN or end or main:
                continue
            until = -1
        if name == "a":
            in_link = not end
        if name in _MAIN:
            main = max(0, main + (-1 if end else 1))
        elif not end and name not in _VOID and name not in ("html", "body"):
            if name in DROPPED or (name == "header" and not main) or _marked(m.group(4)):
                until, proper = ends[tag]
                if not proper:
                    until = next((k for k in range(tag + 1, len(tags)) if tags[k][0] not in INLINE), len(tags))
    end_line()
    article = any(inside and text for text, _, inside in out)
    return [(text, length) if inside or not article else ("", 0) for text, length, inside in out]


def surges(lengths: list[int], window: int = WINDOW, least: int = LEAST) -> list[tuple[int, int]]:
    """(first line, line after the last) of each run from a surge to the next dive of the sums over `window` lines.

    A run begins behind the last line of a window at the threshold and ends before the first line of the next one.
    With fewer lines than a window, all are one run.
    """
    sums = [0]
    for n in lengths:
        sums.append(sums[-1] + n)
    out, begin, at = [], 0, 0
    for at in range(len(lengths) - window + 1):
        if sums[at + window] - sums[at] <= least:
            if at > begin:
                out.append((begin, at))
            begin = at + window
    return [*out, (begin, len(lengths))] if begin < len(lengths) else out


def main_text(page: str, window: int = WINDOW, least: int = LEAST) -> str:
    """The blocks between surges and dives, joined by one space; empty if a page has none.

    A page whose text is all in links has no surge, and gives all of it.
    """
    found = lines(page)
    lengths = [length for _, length in found]
    runs = surges(lengths, window, least) if any(lengths) else [(0, len(found))]
    return " ".join(text for begin, end in runs for text, _ in found[begin:end] if text)


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url"), window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """The columns in keep, text and n_chars of every row; a null or empty page gives an empty text.

    Rows that repeat an id each come back, an empty table gives an empty table, and other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py() or "", window, least) for p in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars bigint"
    return pages.select(*keep, F.col(html_column).alias("_html")).mapInArrow(run, schema)
