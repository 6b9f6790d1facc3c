"""Main text of web pages by nearest-URL page differencing.

A page is cut into text lines at its block elements; a line has its text and its path, the elements above it with their
classes and ids. Pages are ordered by host, path and the rest of the URL, so that the different pages just before and after
(``NEAR`` each) have the nearest URLs of the host. Two pages are aligned by longest common subsequences.

- Lines of equal text that are aligned are shared, and go: those outside of a marked article (``article``, ``main``) if one near page
  shares them, those inside if ``SEVERAL`` do. Near pages that are copies don't count.
- Furniture whose words differ from page to page is aligned by path. A line whose path names furniture (by class, id or role)
  goes if a near page has a line at the same place; a name alone deletes nothing where there is a near page to compare with.
  A page that is alone on its host has none: there the name decides. Inside of a marked article a class or id names furniture
  only as a whole (``comment-list``, not ``comment-on-the-law``), a header or banner is the article's own, and its first heading stays.
- Elements that are no text by the meaning of their tag (scripts, styles, forms, ``nav``, ``aside``, ``header`` and ``footer`` outside of
  an article) are left out before the comparison.

A near page is a copy if what it doesn't share is mostly the same text in slightly other lines, and a template if what it
doesn't share differs in its words; see ``is_copy``.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?:!|\?)[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_PLAIN = re.compile(r"<!--.*?(?:-->|$)|<(?:!|\?)[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)  # quotes do not hide a ">"
MISQUOTED = 16  # after so many tags whose quotes don't close, quotes of the page count no more
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
RAW = frozenset("script style noscript template textarea title iframe svg object select canvas".split())
DROPPED = RAW | frozenset("head nav header footer aside form button".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
SPACED = frozenset("br wbr img hr input".split())
#: words of a class or id that name furniture, and roles that do
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related respond replies reply share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
#: words that may stand beside these in a name inside of an article
NEUTRAL = frozenset("area article author bar block body bottom box container content count entry feed footer form header icons inline inner item items left link links list main meta news note outer page panel post posts reader right section site slot text thread title top unit user wrap wrapper zone".split())
OWN = frozenset("banner header masthead".split())  # an article may have these itself
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
_CLOSES = {tag: frozenset("p".split()) for tag in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
_CLOSES |= {"li": frozenset(["li", "p"]), "dd": frozenset(["dd", "dt", "p"]), "dt": frozenset(["dd", "dt", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
_SCOPE = frozenset("article aside body div footer form header html li main nav ol section table td th ul".split())
NEAR = 2
SEVERAL = 2
PART_BYTES = 32 << 20  # html of a part


class Line(NamedTuple):
    text: str
    article: bool  # whether the page marks it as its article
    place: int  # stands for the path of the elements above it
    named: int  # stands for the path down to the outermost element that names furniture; 0: none


def _names(value: str, article: bool) -> bool:
    """Whether a class or id names furniture; inside of an article only by whole names."""
    if not article:
        return not FURNITURE.isdisjoint(_WORDS.findall(value))
    for name in value.split():
        listed = FURNITURE.intersection(found := _WORDS.findall(name))
        if listed - OWN and all(word in listed or word in NEUTRAL for word in found):
            return True
    return False


def _attributes(tag: str, raw: str, article: bool) -> tuple[str, bool, bool]:
    """(the element with its class and id, whether it is hidden, whether it names furniture)."""
    own, hidden, named = [tag], False, False
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value) is not None
        if name in ("class", "id", "role"):
            own.append(f"{name}={_DIGITS.sub('0', value)}")
            listed = value in ROLES if name == "role" else _names(value, article)
            named |= listed and tag not in ("html", "body", "article", "main")
    return "|".join(own), hidden, named


def lines(page: str) -> list[Line]:
    """The text lines of a page in order, without the elements that are no text by their tag.

    The time grows with the page alone: a search that finds nothing isn't made again, paths are hashed step by step, and the
    open elements are counted by scope, so that the stack is searched only for what is there to be closed.
    """
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, int, int]] = []  # tag; hidden, in the article, path, named path (own or above)
    hidden, article, place, named = False, False, 0, 0
    scopes: list[tuple[str, Counter[str]]] = [("", Counter())]  # the open scopes, each with the open elements right in it
    opened: Counter[str] = Counter()
    titled = False  # whether the article has had a heading
    absent: set[str] = set()  # raw elements that no tag closes any more
    misquoted = at = 0
    last = page.rfind(">") + 1

    def flush() -> None:
        nonlocal titled
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                own = article and not titled and bool(stack) and stack[-1][0] in HEADINGS
                titled = titled or own
                out.append(Line(text, article, place, 0 if own else named))
            parts.clear()

    def close(depth: int) -> None:
        nonlocal hidden, article, place, named, titled
        while len(stack) > depth:
            tag = stack.pop()[0]
            if tag in _SCOPE:
                scopes.pop()
            scopes[-1][1][tag] -= 1
            opened[tag] -= 1
        hidden, article, place, named = stack[-1][1:] if stack else (False, False, 0, 0)
        titled = titled and article

    lower = None
    while m := (_TOKEN if misquoted < MISQUOTED else _PLAIN).search(page, at, last):
        if not hidden and m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if page.startswith("<!--", m.start()) and not page.endswith("-->", m.start(), at):
            at = len(page)  # a comment that never ends
        slash, tag, attributes, *other = m.groups("")
        if other and other[1]:
            slash, tag, attributes = other
            misquoted += 1
        tag = tag.lower()
        if not tag:
            continue
        ends = slash == "/"
        if tag in SPACED and not hidden:
            parts.append(" ")
        if tag in BLOCKS:
            flush()
        if ends:
            if opened[tag] if tag in _SCOPE else scopes[-1][1][tag]:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                close(depth)
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            end = -1 if tag in absent else lower.find("</" + tag, at)
            if end < 0:
                absent.add(tag)
                at = len(page) if tag in ("script", "style", "textarea", "title") else at
                continue
            stop = page.find(">", end)
            at = len(page) if stop < 0 else stop + 1
            continue
        if closes := _CLOSES.get(tag):
            k = len(stack) - 1
            while k >= 0 and (scopes[-1][0] in closes or any(scopes[-1][1][c] > 0 for c in closes)):
                if stack[k][0] in closes:
                    close(k)
                k -= 1
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        own, unseen, listed = _attributes(tag, attributes, article) if attributes else (tag, False, False)
        if tag in BLOCKS or attributes:
            place = hash((place, own)) or 1
        named = named or (place if listed else 0)
        hidden = hidden or unseen or tag in DROPPED and not (tag == "header" and article)
        article = article or tag in MAIN
        stack.append((tag, hidden, article, place, named))
        opened[tag] += 1
        scopes[-1][1][tag] += 1
        if tag in _SCOPE:
            scopes.append((tag, Counter()))
    if not hidden and at < len(page):
        rest = page.find("<!--", at)
        parts.append(page[at : rest if rest >= 0 else len(page)])
    flush()
    return out


def common(a: list[str], b: list[str]) -> set[int]:
    """The places in ``a`` of a longest common subsequence with ``b``, by bit-parallel rows."""
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for line in a:
        u = v & where.get(line, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    found, j = set(), len(b) - 1
    for i in range(len(a) - 1, -1, -1):
        # a zero in row i marks one more in the length; it is new in this row if the row before has a one there
        while j >= 0 and rows[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        before = rows[i - 1] if i else full
        if before >> j & 1:
            found.add(i)
            j -= 1
    return found


def is_copy(own: list[Line], other: list[Line], shared: set[int], thirds: list[set[int]]) -> bool:
    """Whether a near page is the same text again, and no other text under the same template.

    What the two don't share decides: nothing on one side, or three quarters of the words, is an edit. Other words are another text,
    but if most of the page (of its article, where one is marked) is shared, only if a third page shares it as well, or
    there is no article: one page alone can't tell a long shared text from a template.
    """
    marked = any(line.article for line in own)
    size = lambda found: sum(len(own[i].text) for i in found if own[i].article or not marked)
    if 2 * size(shared) <= size(range(len(own))):
        return False
    rest = [own[i].text for i in range(len(own)) if i not in shared]
    theirs = Counter(line.text for line in other) - Counter(own[i].text for i in shared)
    a, b = ({w for text in texts for w in text.lower().split()} for texts in (rest, theirs))
    if not a or not b or 4 * len(a & b) > 3 * min(len(a), len(b)):
        return True
    return marked or not any(2 * size(shared & t) > size(shared) for t in thirds)


def difference(own: list[Line], near: list[list[Line]]) -> list[bool]:
    """Which lines of a page stay beside its near pages.

    Lines that name furniture are aligned by path, all others by text. Near pages that are alike in those others count once.
    """
    plain = [i for i, line in enumerate(own) if not line.named]
    rest = [own[i] for i in plain]
    times: Counter[int] = Counter()
    others: dict[tuple, list[Line]] = {}
    for page in near:
        lines_ = [line for line in page if not line.named]
        others.setdefault(tuple(line.text for line in lines_), lines_)
    others.pop(tuple(line.text for line in rest), None)
    found = [common([line.text for line in rest], list(texts)) for texts in others]
    for k, (other, shared) in enumerate(zip(others.values(), found, strict=True)):
        if not is_copy(rest, other, shared, found[:k] + found[k + 1 :]):
            times.update(plain[i] for i in shared)
    listed = [i for i, line in enumerate(own) if line.named]
    gone = set(listed)
    if listed and near:
        met: set[str] = set()
        for page in near:
            aligned = common([own[i].named for i in listed], [line.named for line in page if line.named])
            met.update(own[listed[j]].named for j in aligned)
        gone = {i for i in listed if own[i].named in met}
    return [i not in gone and times[i] < (SEVERAL if line.article else 1) for i, line in enumerate(own)]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by part, host and path. Pages of equal html in a row are one entry; it is held back until ``NEAR``
    more entries of its host are read. Pages of context are compared with and not returned."""
    now = None
    run: list[tuple[int, list[Line], list[tuple]]] = []  # entries of the host: hash, lines, (page_id, url) of the pages
    at = 0  # the first of them that is held back
    rows: list[tuple] = []

    def settle(last: bool) -> None:
        nonlocal at
        while at < len(run) - (0 if last else NEAR):
            _, own, pages = run[at]
            if pages:
                stays = difference(own, [n for _, n, _ in run[max(0, at - NEAR) : at] + run[at + 1 : at + 1 + NEAR]])
                text = " ".join(line.text for line, stay in zip(own, stays, strict=True) if stay)
                removed = len(own) - sum(stays)
                rows.extend((page_id, url, text, removed) for page_id, url in pages)
                pages.clear()
            at += 1
        if at > NEAR:
            del run[: at - NEAR]
            at = NEAR

    def batch_of(k: int) -> pa.RecordBatch:
        cols = list(zip(*rows[:k], strict=True))
        del rows[:k]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "url", "text", "n_removed"])

    for batch in batches:
        columns = [batch.column(c) for c in ("part", "host", "context", "h", "page_id", "url", "html")]
        for i in range(batch.num_rows):
            part, host, context, h, page_id, url, page = (c[i].as_py() for c in columns)
            if now != (part, host):
                settle(True)
                now, at = (part, host), 0
                run.clear()
            if page is None:
                if not context:
                    rows.append((page_id, url, "", 0))
            else:
                if not run or run[-1][0] != h:
                    run.append((h, lines(page), []))
                    settle(False)
                if not context:
                    run[-1][2].append((page_id, url))
            while len(rows) >= 1000:
                yield batch_of(1000)
    settle(True)
    while rows:
        yield batch_of(1000)


KEYS = ("host", "path", "url", "page_id", "h")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the sorted keys of each part: the first row, and the first and last ``NEAR`` + 1 runs of equal (host, h), a row for each."""
    first, head, tail, before = None, [], [], None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in KEYS]
        for row in zip(*columns, strict=True):
            first = first or row
            entry = (row[0], row[4])
            if entry != before:
                if len(head) <= NEAR:
                    head.append(row)
                tail.append(row)
                del tail[: -NEAR - 1]
                before = entry
            else:
                tail[-1] = row
    part = TaskContext.get().partitionId()
    if first:
        rows = [("first", first), *(("head", r) for r in head), *(("tail", r) for r in tail)]
        columns = list(zip(*((part, i, kind, *r) for i, (kind, r) in enumerate(rows)), strict=True))
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "i", "kind", *KEYS])


def _borders(ends: list) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """The first key of each part, and for the rows near a border the parts that need them as context."""
    parts: dict[int, dict[str, list[tuple]]] = {}
    for r in sorted(ends, key=lambda r: (r["part"], r["i"])):
        parts.setdefault(r["part"], {"first": [], "head": [], "tail": []})[r["kind"]].append(tuple(r[c] for c in KEYS))
    order = [parts[p] for p in sorted(parts)]
    needed: dict[tuple, list[int]] = {}
    for p in range(len(order)):
        for step, kind in ((-1, "tail"), (1, "head")):
            host = order[p]["head"][0][0] if step < 0 else order[p]["tail"][-1][0]
            beyond = (row for q in (range(p - 1, -1, -1) if step < 0 else range(p + 1, len(order))) for row in order[q][kind][::step])
            seen: list[int] = []
            for row in beyond:
                if row[0] != host or len(seen) > NEAR:
                    break
                if not seen or seen[-1] != row[4]:
                    seen.append(row[4])
                    needed.setdefault(row, []).append(p)
    return [x["first"][0] for x in order], needed


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_removed) for every page; n_removed: lines that the comparison deleted.

    The keys of the pages are ordered by (host, path, url, page_id) first; that gives the borders of the parts and, for each
    border, which pages on its other side are near (a few rows a part reach the driver). Then the pages are dealt out to
    parts, with the near ones of the next parts as context, so a host with very many pages is split by path and what is near
    doesn't depend on the parts. Null html: empty text. Null or odd urls share a host of their own. Pages of equal html that follow
    each other are one entry; equal texts in other html are copies, and nothing is deleted between them. Lines that come more
    than once on a page are aligned one to one. A page alone on its host keeps all lines that no name marks as furniture. Of two
    pages alone on their host that share most of their text nothing shared is deleted: no third page tells a template from a
    copy. Other columns are ignored; no rows give no rows.
    """
    spark = pages.sparkSession
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("given"),
        F.col("html").cast("string").alias("html"),
        F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"),
        url.alias("url"),
    ).withColumn("h", F.xxhash64("html"))
    size = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
    keyed = rows.where("html is not null").select(*KEYS).withColumn("page_id", F.coalesce("page_id", F.lit(-(1 << 63))))
    kinds = "part int, i int, kind string, host string, path string, url string, page_id long, h long"
    firsts, needed = _borders(keyed.repartitionByRange(n, *KEYS).sortWithinPartitions(*KEYS).mapInArrow(_ends, kinds).collect())
    shared = spark.sparkContext.broadcast((firsts, needed))

    @F.pandas_udf("array<long>")
    def places(host: pd.Series, path: pd.Series, url: pd.Series, page_id: pd.Series, h: pd.Series) -> pd.Series:
        first, near = shared.value
        out = []
        for row in zip(host, path, url, page_id.tolist(), h.tolist(), strict=True):
            own = max(0, bisect_right(first, row) - 1)
            out.append([2 * own, *(2 * p + 1 for p in near.get(row, ()) if p != own)])
        return pd.Series(out)

    dealt = rows.withColumn("at", F.explode(places("host", "path", "url", F.coalesce("page_id", F.lit(-(1 << 63))), "h")))
    dealt = dealt.select(F.shiftright("at", 1).alias("part"), (F.col("at") % 2 == 1).alias("context"), *KEYS, "given", "html")
    sorted_ = dealt.repartition(n, "part").sortWithinPartitions("part", *KEYS)
    sorted_ = sorted_.select("part", "host", "context", "h", "page_id", F.col("given").alias("url"), "html")
    out = sorted_.mapInArrow(_extract, "page_id long, url string, text string, n_removed long")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_removed")
