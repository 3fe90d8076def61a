"""Main text of web pages: structure where the markup tells, differencing with the page of the nearest URL where it does not."""

from __future__ import annotations

import hashlib
import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.prefix import running_totals
from tallyline.session import materialize

#: Where a line stands: in an element that is never article, unmarked, or in an article or main element.
ASIDE, UNMARKED, ARTICLE = 0, 1, 2
#: From this share of shared unmarked lines on, two pages may be versions of one text and a second page is asked.
SAME_PAGE = 0.8
#: A line with so many words or characters, or a short one that ends a sentence, is prose and no link.
PROSE_WORDS, PROSE_CHARS, SENTENCE_WORDS = 10, 60, 4

# Elements and the words of class, id and role that say what an element holds.
_NEVER = frozenset("nav footer aside form script style noscript template iframe svg head menu dialog select button object canvas audio video map".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul caption".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal "
    "overlay newsletter subscribe subscription signup nav navbar navigation menu breadcrumb breadcrumbs sidebar masthead topbar footer comment comments "
    "disqus respond share sharing social related recommended widget toolbar login pagination pager copyright disclaimer skip".split()
)
# What may stand beside such a word in a name: a name of the first, or with the first in front, is that of the thing itself.
_PARTS = frozenset(
    "area bar block body bottom box button buttons center column container content element form fixed group header heading holder icon icons inner inside item items "
    "left link links list main mobile outer overlay page panel post posts primary region right row secondary section site slot sticky text title top unit widget wrap wrapper".split()
)
# Words in front that say the thing is not this element, and those of lists of teasers, which may hold articles of their own.
_DENIALS = frozenset("no not non has have with without is hide hidden after before under above below".split())
_TEASERS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus respond related recommended widget sidebar footer nav menu".split())
_SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_OPEN_ENDED = frozenset("html body main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"'=]++|=\s*+\"[^\"]*\"|=\s*+'[^']*'|[=\"'])*+)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Line(NamedTuple):
    text: str
    place: int
    heading: bool = False


def _side_name(name: str) -> str | None:
    """The word of a class or id that makes its element no part of an article, or null.

    The word is the whole name, its end (``left-sidebar``), or its beginning before parts of pages only
    (``comments-area``); with a denial in front (``no-comments``, ``has-sidebar``) the name is of something else.
    """
    parts = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
    if not parts or parts[0] in _DENIALS:
        return None
    if "".join(parts) in _SIDE_WORDS:
        return "".join(parts)
    if parts[-1] in _SIDE_WORDS and not _DENIALS.intersection(parts):
        return parts[-1]
    return parts[0] if parts[0] in _SIDE_WORDS and all(p in _PARTS or p in _SIDE_WORDS or p.isdigit() for p in parts[1:]) else None


def _is_aside(tag: str, attributes: str, place: int) -> bool:
    if tag in _NEVER or (tag == "header" and place != ARTICLE):
        return True
    if not attributes.strip() or tag in _OPEN_ENDED:
        return False
    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if named.get("role", "").strip().lower() in _SIDE_ROLES or _HIDDEN.search(named.get("style", "").lower()):
        return True
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"=\s*(?:\"[^\"]*\"|'[^']*')", "=", attributes).lower()) or named.get("aria-hidden", "").lower() == "true":
        return True
    if tag == "article" or re.search(r"\bmain\b", named.get("role", "").lower()):
        return False
    return any(_side_name(name) for key in ("class", "id") for name in named.get(key, "").split())


def _may_hold_article(tag: str, attributes: str) -> bool:
    """Whether an element that is aside by its class or id alone may be the frame of a page: none of its names is of a list of teasers."""
    if tag in _NEVER or tag == "header":
        return False
    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    words = {_side_name(name) for key in ("class", "id") for name in named.get(key, "").split()} - {None}
    return bool(words) and not words & _TEASERS and named.get("role", "").strip().lower() not in _SIDE_ROLES


def lines_of(page: str) -> list[Line]:
    """The text blocks of a page in order, with white space reduced and character references decoded once.

    Tags need not match: only elements that change the place of a text are kept on a stack, and an end tag closes the
    nearest one of its name. Comments, scripts and styles give nothing; a line break within a block is white space.
    """
    lines: list[Line] = []
    parts: list[str] = []
    stack: list[list] = []
    place, own, at, end, heading = UNMARKED, UNMARKED, 0, len(page), False

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                lines.append(Line(text, own, heading))
            parts.clear()

    while at < end:
        token = _TOKEN.search(page, at)
        stop = token.start() if token else end
        if stop > at and not (place == ASIDE and stack and stack[-1][3]):
            if not parts:
                own = place
            parts.append(html.unescape(page[at:stop]))
        if not token:
            break
        at = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            flush()
            heading = tag in ("h1", "h2") and not token[1]
        elif tag in ("br", "td", "th", "img") and parts:
            parts.append(" ")
        if token[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    stack[k][2] -= 1
                    if not stack[k][2]:
                        if not stack[k][3]:
                            flush()
                        del stack[k:]
                        place = stack[-1][1] if stack else UNMARKED
                    break
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(page, at)
            at = close.start() if close else end
            if close:
                at = page.find(">", at) + 1 or end
            continue
        if tag in _VOID or token[3].endswith("/") and tag not in _BLOCK:
            continue
        if tag == "body" and stack and stack[-1][0] == "head":
            flush()
            stack.pop()
            place = stack[-1][1] if stack else UNMARKED
        # An element that is aside by its name alone may be the frame of a page, so what is in it is looked at too.
        wanted, frame, framed = place, False, place == ASIDE and stack and stack[-1][4]
        if place != ASIDE or framed:
            if _is_aside(tag, token[3], place):
                wanted, frame = ASIDE, _may_hold_article(tag, token[3])
            elif tag in ("article", "main") or re.search(r"role\s*=\s*[\"']?main\b", token[3]):
                wanted = ARTICLE
        if wanted != place or framed and wanted == ASIDE and not frame and _is_aside(tag, token[3], place):
            inline = tag not in _BLOCK and tag not in _NEVER
            if not inline:
                flush()
            stack.append([tag, wanted, 1, inline, frame])
            place = wanted
        elif stack:
            for entry in reversed(stack):
                if entry[0] == tag:
                    entry[2] += 1
                    break
    flush()
    return lines


def _is_prose(text: str) -> bool:
    words = len(text.split())
    return words >= PROSE_WORDS or len(text) >= PROSE_CHARS or text.endswith(("。", "！", "？")) or (words >= SENTENCE_WORDS and text.rstrip("\"'»”’)").endswith((".", "!", "?", "…")))


def _entries(lines: list[Line]) -> tuple[list[str], list[int]]:
    """Texts that may be main text, in page order, and for each its place among the lines outside articles (-1: article text).

    On a page with article text, unmarked lines before all of it or after all of it are left out if none of them is prose,
    but for headlines with no other unmarked line between them and the article text.
    """
    marked = [k for k, line in enumerate(lines) if line.place == ARTICLE]
    first, last = (marked[0], marked[-1] + 1) if marked else (0, 0)
    edges = [range(0, first), range(last, len(lines))] if marked else []
    left = {k for edge in edges if not any(lines[k].place == UNMARKED and _is_prose(lines[k].text) for k in edge) for k in edge}
    k = first - 1
    while k >= 0 and (lines[k].place == ASIDE or lines[k].heading):
        left.discard(k)
        k -= 1
    texts: list[str] = []
    places: list[int] = []
    outside = 0
    run: list[str] = []
    for k, line in enumerate(lines):
        if line.place == ARTICLE:
            run.append(line.text)
            continue
        if line.place == UNMARKED and k not in left:
            if run:
                texts.append("\n\n".join(run))
                places.append(-1)
                run = []
            texts.append(line.text)
            places.append(outside)
        outside += 1
    if run:
        texts.append("\n\n".join(run))
        places.append(-1)
    return texts, places


def _ones(value: int, bits: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(value.to_bytes((bits + 7) // 8, "little"), dtype=np.uint8), bitorder="little")[:bits]


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit rows of the LCS table of ``a`` against ``b``: a zero bit is a step up between neighbouring columns."""
    where: dict[int, int] = {}
    for j, symbol in enumerate(b):
        where[symbol] = where.get(symbol, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row, rows = full, []
    for symbol in a:
        met = row & where.get(symbol, 0)
        row = ((row + met) | (row - met)) & full
        rows.append(row)
    return rows


def _common(a: list[int], b: list[int], at: int, cells: int, found: np.ndarray) -> None:
    if not a or not b:
        return
    if len(a) * len(b) > cells and len(a) > 1:
        # Too large to keep all rows: cut ``a`` in two where both halves' best scores add up to the most (linear memory).
        half = len(a) // 2
        upper = np.concatenate(([0], np.cumsum(1 - _ones(_rows(a[:half], b)[-1], len(b)).astype(np.int64))))
        lower = np.concatenate(([0], np.cumsum(1 - _ones(_rows(a[half:][::-1], b[::-1])[-1], len(b)).astype(np.int64))))[::-1]
        cut = int((upper + lower).argmax())
        _common(a[:half], b[:cut], at, cells, found)
        _common(a[half:], b[cut:], at + half, cells, found)
        return
    rows = _rows(a, b)
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not (i and not rows[i - 1] >> (j - 1) & 1):
            j -= 1
            found[at + i] = True


def shared_lines(own: list[int], other: list[int], cells: int = 1 << 28) -> np.ndarray:
    """Which of ``own`` lie on a longest common subsequence with ``other``; ties go to one of the longest.

    Equal ends are matched first and lines that the other page lacks are left out; bit-parallel rows make the rest cost
    len(own) * len(other) / 64 steps, and tables over ``cells`` cells are cut so that memory stays linear.
    """
    found = np.zeros(len(own), dtype=bool)
    head = 0
    while head < min(len(own), len(other)) and own[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(own), len(other)) - head and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    found[:head] = True
    found[len(own) - tail :] = True
    mine, theirs = own[head : len(own) - tail], other[head : len(other) - tail]
    both = set(mine) & set(theirs)
    kept = [k for k, x in enumerate(mine) if x in both]
    inner = np.zeros(len(kept), dtype=bool)
    _common([mine[k] for k in kept], [x for x in theirs if x in both], 0, cells, inner)
    found[head + np.array(kept, dtype=np.int64)[inner]] = True
    return found


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def parsed_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Rows ``row``, ``page_id``, ``url``, ``host``, ``path``, ``texts``, ``open``, ``outside``.

    ``row`` is a 64-bit hash of the page's id, URL and markup. ``outside`` has a hash per line that is not in an article
    element, in page order; ``texts`` and ``open`` are those of ``_entries``. Whole pages are read; null is an empty page.
    """

    @F.arrow_udf("struct<texts:array<string>,open:array<int>,outside:array<bigint>>")
    def parse(values: pa.Array) -> pa.Array:
        rows = []
        for value in values:
            lines = lines_of(value.as_py() or "")
            texts, places = _entries(lines)
            rows.append({"texts": texts, "open": places, "outside": [_hash(line.text) for line in lines if line.place != ARTICLE]})
        kind = pa.struct([("texts", pa.list_(pa.string())), ("open", pa.list_(pa.int32())), ("outside", pa.list_(pa.int64()))])
        return pa.array(rows, kind)

    url = F.col(f"`{url_column}`").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), "^[^?#/]*//[^/?#]*([^?#]*)", 1)
    own, html_text = F.col(f"`{id_column}`"), F.col(f"`{html_column}`").cast("string")
    told = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in (own, url, html_text)]
    rows = pages.select(F.xxhash64(*told).alias("row"), own.alias("page_id"), F.col(f"`{url_column}`").alias("url"), host.alias("host"), path.alias("path"), parse(html_text).alias("p"))
    return rows.select("row", "page_id", "url", "host", "path", "p.*")


def _alike(a: Column, b: Column) -> Column:
    """Leading path segments that two paths share."""
    mine, other = F.split(a, "/"), F.split(b, "/")
    places = F.sequence(F.lit(1), F.least(F.size(mine), F.size(other)))
    return F.size(F.filter(places, lambda k: F.slice(mine, 1, k) == F.slice(other, 1, k)))


def neighbours(parsed: DataFrame) -> DataFrame:
    """``row``, ``near``, ``second``: for every page the one of its host before or after it in path order that shares more leading segments.

    ``second`` is the one on the other side, or if that is missing the one beyond ``near``; null if the host has two pages.

    Pages are numbered in the order of host, path and row by running totals, so a host with a third of all pages is
    spread over many ranges, and the pages before and after are found by joins on the number. A page that is alone on its
    host, or has no host, has none.
    """
    order = running_totals(parsed.select("row", "host", "path"), ["host", "path", "row"], {"number": F.lit(1).cast("bigint")})
    order = materialize(order, "order")
    beside = lambda step, name: order.select((F.col("number") - step).alias("number"), F.struct("row", "host", "path").alias(name))
    placed = order.join(beside(-1, "before"), "number", "left").join(beside(1, "after"), "number", "left")
    placed = placed.join(beside(-2, "earlier"), "number", "left").join(beside(2, "later"), "number", "left")
    own = lambda side: (F.col(f"{side}.host") == F.col("host")) & (F.col("host") != "")
    likeness = lambda side: F.when(own(side), _alike(F.col("path"), F.col(f"{side}.path"))).otherwise(0)
    at = lambda side: F.when(own(side), F.col(f"{side}.row"))
    before, after = likeness("before"), likeness("after")
    back = (before > 0) & (before >= after)
    near = F.when(back, F.col("before.row")).when(after > 0, F.col("after.row"))
    second = F.when(back, F.coalesce(at("after"), at("earlier"))).otherwise(F.coalesce(at("before"), at("later")))
    return placed.select("row", near.alias("near"), second.alias("second")).where("near is not null")


def main_texts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_outside`` (lines outside article elements), ``n_shared`` (of those, shared with the neighbour).

    Every page is aligned with the page of the nearest URL by a longest common subsequence of the lines outside article
    elements. Lines of article and main elements are text; lines of navigation, notices, adverts, forms and the like are
    not. Every unmarked line is text unless the neighbour shares it; on a page with article text, those before or after all
    of it are left out if none of them is prose, but for headlines just before it. If nearly all unmarked lines are shared, only those that a second page of
    the host shares too are deleted (with two pages on the host: those that the neighbour shares), and none if the pages'
    lines are equal. Null and empty pages give an empty text; rows that repeat a page are no neighbours of each other and
    get the same text; other columns are ignored; no pages give no rows.

    Pages are parsed twice, once for the hashes of their lines, which are stored, and once for their texts, which are
    shuffled once and never stored.
    """
    parsed = parsed_pages(pages, id_column, url_column, html_column)
    lines = materialize(parsed.select("row", "host", "path", "outside", F.filter("open", lambda k: k >= 0).alias("open")).dropDuplicates(["row"]), "lines")

    @F.arrow_udf("array<boolean>")
    def align(own: pa.Array, other: pa.Array) -> pa.Array:
        return pa.array([shared_lines(a.as_py(), b.as_py()).tolist() for a, b in zip(own, other)], pa.list_(pa.bool_()))

    hashes = lines.select("row", "outside")
    paired = lines.select("row", "outside", "open").join(neighbours(lines), "row").join(hashes.toDF("near", "theirs"), "near")
    n_hit = F.size(F.filter("open", lambda k: F.get("shared", k)))
    aligned = paired.withColumn("shared", align("outside", "theirs")).select(
        "row",
        F.size(F.filter("shared", lambda x: x)).alias("n_shared"),
        F.when(F.size("open") > 0, F.col("shared")).alias("shared"),
        (F.col("outside") == F.col("theirs")).alias("equal"),
        ((F.size("open") > 0) & (n_hit >= F.ceil(F.size("open") * F.lit(SAME_PAGE)))).alias("close"),
        "second",
    )
    aligned = materialize(aligned, "aligned")
    asked = aligned.where("close and second is not null").select("row", "second").join(hashes, "row").join(hashes.toDF("second", "others"), "second")
    asked = asked.select("row", align("outside", "others").alias("also"), (F.col("outside") == F.col("others")).alias("equal_too"))
    both = F.zip_with("shared", "also", lambda x, y: x & y)
    equal = F.col("close") & F.col("equal") & F.coalesce("equal_too", F.lit(True))
    deleted = F.when(equal, F.lit(None)).when(F.col("also").isNotNull(), both).otherwise(F.col("shared"))
    judged = aligned.join(asked, "row", "left").select("row", "n_shared", deleted.alias("deleted"))
    joined = parsed.join(judged, "row", "left")
    kept = F.filter("texts", lambda _, k: ~F.coalesce(F.get("deleted", F.get("open", k)), F.lit(False)))
    return joined.select(
        "page_id",
        "url",
        F.array_join(kept, "\n\n").alias("text"),
        F.size("outside").cast("bigint").alias("n_outside"),
        F.coalesce("n_shared", F.lit(0)).cast("bigint").alias("n_shared"),
    )
