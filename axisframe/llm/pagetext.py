"""Main text of web pages by nearest-URL page differencing and page structure."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard

#: Pages that a page is held against, and places before and after it that they are looked for in.
NEIGHBOURS = 6
WINDOW = 8
#: A line of a marked article goes only if so many neighbours or more have it, and all of them.
ALL_OF = 4
#: Pages of a part, at least.
PART = 64

# Names of HTML elements and the words that mark a container's role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
LEFT_OUT = frozenset("nav footer aside form button select dialog menu svg canvas object audio video map datalist head label".split())
CONTAINERS = frozenset("div section ul ol dl table header center details fieldset span p h1 h2 h3 h4 h5 h6 li figure article".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr "
    "menu modal nav navbar navigation newsletter notice popup promo promoted related respond share sharing sidebar skip social sponsor sponsored subscribe "
    "toolbar widget replies reply".split()
)
TOP_WORDS = frozenset("header masthead topbar".split())
STATE_WORDS = frozenset("has with no without is not hide show".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|iframe|textarea|title|xmp|noembed|noframes)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


@dataclass
class Page:
    """The text blocks of a page, in order: whether each is of the article and whether of a part that is left out."""

    lines: list[str]
    article: list[bool]
    outside: list[bool]
    marked: bool


def _names_role(value: str, inside: bool) -> bool:
    """Whether one of the names in a class or id says that an element is no main text; has-sidebar and the like say nothing."""
    for name in value.lower().split():
        words = re.split("[_-]+", name)
        if words[0] not in STATE_WORDS and (not ROLE_WORDS.isdisjoint(words) or not inside and not TOP_WORDS.isdisjoint(words)):
            return True
    return False


def _marked_out(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form or reader comment."""
    if name in LEFT_OUT or name == "header" and not inside:
        return True
    if not attributes or name not in CONTAINERS:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and _names_role(value, inside):
            return True
        if key == "role" and value.lower() in ROLES:
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes))


def parse(source: str) -> Page:
    """Cut a page into blocks. Inline marks go, ``<br>`` is white space, unclosed elements end with what holds them."""
    page = Page([], [], [], False)
    text: list[str] = []
    article = depth = 0
    skipped = ""

    def flush():
        if text:
            one = " ".join(("".join(text) if "&" not in "".join(text) else html.unescape("".join(text))).split())
            text.clear()
            if one:
                page.lines.append(one)
                page.article.append(article > 0)
                page.outside.append(bool(skipped))

    at = 0
    for m in MARK.finditer(source):
        if m.start() > at:
            text.append(source[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            if m[0].startswith("<![") and len(m[0]) > 12:
                text.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if name == "br":
            text.append(" ")
        elif name in BLOCKS or name in LEFT_OUT:
            flush()
        closing = bool(m[2])
        if skipped:
            ends = False
            if skipped in ("p", "li"):
                ends = name == skipped or name in BLOCKS and (closing or skipped == "p")
                over = ends and closing and name == skipped
            elif name == skipped:
                depth += -1 if closing else 1
                ends = over = depth <= 0
            elif name in ("article", "main") or closing and name in ("body", "html") or skipped == "head" and name == "body":
                ends, over = True, False
            if ends:
                flush()
                skipped, depth = "", 0
                if over:
                    continue
            if skipped:
                continue
        if name in ("article", "main"):
            article = max(0, article + (-1 if closing else 1))
            page.marked = True
        if not closing and name not in VOID and not m[4].endswith("/") and name not in ("article", "main") and _marked_out(name, m[4], article > 0):
            flush()
            skipped, depth = name, 1
        elif not closing and name == "article" and _marked_out(name, m[4], article > 1):
            skipped, depth = name, 1
            article -= 1
    if at < len(source):
        text.append(source[at:])
    flush()
    return page


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of longest common subsequences of ``a`` and every beginning of ``b``, from the empty one on; all places of
    ``b`` at once as the bits of one number."""
    at: dict[int, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & full
    # A zero bit is a place of b at which the length grows.
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _common(a: list[int], b: list[int], at: int, out: set[int]) -> None:
    """Add the places (from ``at`` on) of a longest common subsequence in ``a``: halve ``a``, find where ``b`` divides."""
    if not a or not b:
        return
    if len(a) == 1:
        if a[0] in b:
            out.add(at)
        return
    half = len(a) // 2
    ahead = _prefix_lengths(a[:half], b)
    behind = _prefix_lengths(a[:half - 1 : -1], b[::-1])
    cut = int((ahead + behind[::-1]).argmax())
    _common(a[:half], b[:cut], at, out)
    _common(a[half:], b[cut:], at + half, out)


def aligned(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``; time grows with the product of the lengths over the width
    of a machine word, memory with their sum, however often lines repeat."""
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    end = 0
    while end < len(a) - n and end < len(b) - n and a[-1 - end] == b[-1 - end]:
        end += 1
    out = {*range(n), *range(len(a) - end, len(a))}
    both = {x: k for k, x in enumerate(set(a[n : len(a) - end]) & set(b[n : len(b) - end]))}
    if both:
        places = [i for i in range(n, len(a) - end) if a[i] in both]
        found: set[int] = set()
        _common([both[a[i]] for i in places], [both[x] for x in b[n : len(b) - end] if x in both], 0, found)
        out.update(places[k] for k in found)
    return out


def main_lines(page: Page, shared: dict[int, int], neighbours: int) -> list[str]:
    """Lines of the main text: those that the structure leaves in and that the neighbours do not give away.

    ``shared`` says with how many of the ``neighbours`` a line is aligned. A line goes if most of them have it, a line
    inside a marked article if all of ALL_OF or more have it, as different articles may well have a line in common. If
    the page marks an article, what stands outside goes.
    """
    marked = page.marked and any(page.article)
    kept = []
    for k, line in enumerate(page.lines):
        if page.outside[k] or marked and not page.article[k]:
            continue
        n = shared.get(k, 0)
        if not (n == neighbours >= ALL_OF if page.article[k] else 2 * n > neighbours):
            kept.append(line)
    return kept


def _near(path: str, other: str) -> int:
    """Steps that two paths have in common."""
    n = 0
    for x, y in zip(path.split("/"), other.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


@dataclass
class Entry:
    """A page in its place among the pages of its host."""

    page_id: int | None
    url: str | None
    host: str | None
    path: str
    own: bool
    page: Page
    lines: frozenset[str]
    chars: int


def differs(a: Entry, b: Entry) -> bool:
    """Whether ``b`` can tell what is main text in ``a``, being no copy of it: ``a`` has lines of its own, and the lines that
    only one of them has hold a fifth of the characters of all distinct lines or more."""
    if a.lines is b.lines or a.lines <= b.lines:
        return False
    both = sum(map(len, a.lines & b.lines))
    return 4 * (a.chars + b.chars) >= 9 * both


def neighbours(one: Entry, before: Sequence[Entry], after: Sequence[Entry]) -> list[Entry]:
    """The up to NEIGHBOURS nearest of the pages before and after (nearest first each) on the same host that are no copies:
    those whose paths have more steps in common, then the closer ones."""
    if one.host is None:
        return []
    ranked = [(-_near(one.path, x.path), d, side, x) for side, rows in enumerate((before, after)) for d, x in enumerate(rows) if x.host == one.host]
    ranked.sort(key=lambda r: r[:3])
    out: list[Entry] = []
    for *_, x in ranked:
        if len(out) == NEIGHBOURS:
            break
        # Of copies of one page one is asked.
        if differs(one, x) and all(x.lines != y.lines for y in out):
            out.append(x)
    return out


_RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_shared", pa.int64())])


def _extract(batches):
    """Pages come sorted by part, host and path; each one of the part's own is held against those up to WINDOW places before
    and after it."""
    out: list[tuple] = []
    size = 0
    held: deque[Entry] = deque()
    #: Pages of ``held`` that are done.
    done = 0
    of = None

    def finish(k: int) -> None:
        nonlocal size
        one = held[k]
        if not one.own:
            return
        rows = list(held)
        near = neighbours(one, rows[max(0, k - WINDOW) : k][::-1], rows[k + 1 : k + 1 + WINDOW])
        shared: dict[int, int] = {}
        for x in near:
            for at in aligned(one.page.lines, x.page.lines):
                shared[at] = shared.get(at, 0) + 1
        text = "\n".join(main_lines(one.page, shared, len(near)))
        size += len(text)
        out.append((one.page_id, one.url, text, len(text), sum(2 * n > len(near) for n in shared.values())))

    def batch_of() -> pa.RecordBatch:
        nonlocal size
        columns = list(zip(*out, strict=True)) or [[] for _ in _RESULT]
        out.clear()
        size = 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT, strict=True)], schema=_RESULT)

    for batch in batches:
        for r in range(batch.num_rows):
            page_id, url, source, host, path, part, own = (batch.column(k)[r].as_py() for k in range(7))
            if part != of:
                while done < len(held):
                    finish(done)
                    done += 1
                held.clear()
                done, of = 0, part
            page = parse(source or "")
            last = held[-1] if held else None
            if last is not None and page == last.page:
                lines, page = last.lines, last.page  # a run of exact copies is held once
            else:
                lines = frozenset(page.lines)
            held.append(Entry(page_id, url, host, path or "", own, page, lines, sum(map(len, lines))))
            if len(held) - done > WINDOW:
                finish(done)
                done += 1
            if done > WINDOW:
                held.popleft()
                done -= 1
            if size > 2_000_000:
                yield batch_of()
    while done < len(held):
        finish(done)
        done += 1
    yield batch_of()


def _borders(slim: DataFrame) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Of keys (host, path, page_id) in order, the first of each part but the first, and those WINDOW places before and after
    it. There are as many parts as shuffle partitions, of PART rows at least."""
    spark = slim.sparkSession
    slim = cut(slim.repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id").withColumn("at", F.monotonically_increasing_id()), "keys")
    split = F.shiftright("at", 33)
    sizes = dict(slim.groupBy(split.alias("k")).count().collect())  # one row a partition
    n = sum(sizes.values())
    each = max(PART, -(-n // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    start, at = {}, 0
    for k in sorted(sizes):
        start[k] = at
        at += sizes[k]
    wanted = [x for b in range(each, n - WINDOW, each) for x in (b - WINDOW, b, b + WINDOW)]
    # Where each wanted rank lies: its partition and its place there.
    keys, order = [], sorted(start)
    for x in wanted:
        k = order[bisect_right([start[o] for o in order], x) - 1]
        while sizes[k] <= x - start[k]:
            k = order[order.index(k) + 1]
        keys.append((k << 33) + x - start[k])
    if not keys:
        discard(slim)
        return [], [], []
    found = {r[0]: tuple(r[1:]) for r in slim.join(F.broadcast(spark.createDataFrame([(k,) for k in keys], "at long")), "at").select("at", "host", "path", "page_id").collect()}  # three rows a part
    discard(slim)
    rows = [_key(*found[k]) for k in keys]
    return rows[1::3], rows[::3], rows[2::3]


def _seats(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` partitions a number that a hash deals to it, so that every part has a partition of its own."""
    found: dict[int, int] = {}
    most = 16 * n
    while len(found) < n:
        rows = spark.range(most).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id"))
        found = {r.p: r.id for r in rows.collect()}  # one row a partition
        most *= 4
    return [found[k] for k in range(n)]


def _key(host: str | None, path: str | None, page_id: int | None) -> tuple:
    """A key that sorts as Spark does, nulls first."""
    return tuple((x is not None, x.encode("utf-8") if isinstance(x, str) else x or 0) for x in (host, path, page_id))


def _targets(host: pa.Array, path: pa.Array, page_id: pa.Array, borders: tuple[list, list, list]) -> pa.Array:
    """The parts that each page goes to, its own one first, as (part, own)."""
    first, before, after = borders
    out = []
    for key in zip(host.to_pylist(), path.to_pylist(), page_id.to_pylist(), strict=True):
        key = _key(*key)
        part = bisect_right(first, key)
        rows = [{"part": part, "own": True}]
        if part < len(first) and key >= before[part]:
            rows.append({"part": part + 1, "own": False})
        if part and key < after[part - 1]:
            rows.append({"part": part - 1, "own": False})
        out.append(rows)
    return pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("own", pa.bool_())])))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars, and n_shared (lines that most of its neighbours have too).

    Pages are ordered by (host, path, page_id), which splits a large host over parts; each part also gets the WINDOW pages
    on either side of it, so that no result depends on where parts end. A page is held against the up to NEIGHBOURS nearest
    within that window that are no copies of it; what a longest common subsequence aligns with most of them is deleted
    (``main_lines``). Copies, exact or near, say nothing of what is main text. Null and empty html give an
    empty text; a null url or one without a host is compared with nothing; repeated rows stay apart; an empty table gives
    no rows. Other columns are not read.
    """
    host, path = F.lower(F.try_parse_url("url", F.lit("HOST"))), F.try_parse_url("url", F.lit("PATH"))
    rows = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"))
    borders = _borders(rows.select("host", "path", "page_id"))
    if borders[0]:

        @F.arrow_udf("array<struct<part:int,own:boolean>>")
        def targets(host: pa.Array, path: pa.Array, page_id: pa.Array) -> pa.Array:
            return _targets(host, path, page_id, borders)

        rows = rows.withColumn("to", F.explode(targets.asNondeterministic()("host", "path", "page_id"))).select("page_id", "url", "html", "host", "path", "to.part", "to.own")
        n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        seats = pages.sparkSession.createDataFrame(list(enumerate(_seats(pages.sparkSession, n)[: len(borders[0]) + 1])), "part int, seat long")
        rows = rows.join(F.broadcast(seats), "part").repartition(n, "seat").select("page_id", "url", "html", "host", "path", "part", "own")  # a row a partition is broadcast
    else:
        rows = rows.withColumn("part", F.lit(0)).withColumn("own", F.lit(True)).coalesce(1)
    rows = rows.sortWithinPartitions("part", "host", "path", "page_id")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long, n_shared long")
