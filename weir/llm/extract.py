"""Main text of web pages, by deducing the template that the pages of a host share.

A page is read as tokens: its elements, told apart by their path (with class
names), and its blocks of text, told apart by path and content.  A token's
occurrence vector (how often it stands on each page of the host) is kept as a
digest that adds up over pages in any order, so tokens with equal vectors, an
equivalence class, meet by grouping, and no page set is ever gathered.

The class on most pages of a host is the root of its template; its tokens must
stand in one order on all of its pages.  Any other class is nested in a gap
between two root tokens: it is valid if it has enough tokens, all in that gap
on each page of the class, in one order (repeated as often as the class
occurs).  A class that makes up most of its pages' text is a group of copies,
not a template, and its text stays.

What is left between template tokens is in the slots.  The slots of a host are
weighed by region (``div``, ``section``, ``article``, ...), by the text that
all its pages hold there.  The deepest region with two thirds of the text is
the main part; an ``article`` or ``main`` element around it is a hint that
widens it.  Regions of the template in it that hold under a tenth of the text
(an advert, a byline) are left out, unless the hint says otherwise.  The text
of a page is what its main part has in slots.

Elements that are furniture by their name, or whose class, id or role is made
of furniture words alone (menus, forms, side bars, notices, adverts, comments),
hold no slots.  The words are but a vote: an element that is or holds the
heaviest article or main element of a page stays whatever it is called, and so
does one with most of the text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from weir.llm.common import map_texts, written
from weir.llm.urlfilter import host_of

#: A class is valid with this many tokens, on this share of the host's pages, of at least so many pages.
CLASS_TOKENS, CLASS_SHARE, CLASS_PAGES = 3, 0.5, 4
#: Share of a host's text in its main part, and below which a region of the template in it is left out.
MAIN_SHARE, SMALL_SHARE = 2 / 3, 0.1

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z|(?=<))|</?\Z", re.DOTALL)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text that stand inside a line.
IN_LINE = frozenset("area embed img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math noembed xmp".split())
#: Elements inside a line of text; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold a part of a page; all others belong to the part around them.
REGIONS = frozenset("div section article main".split())
#: Elements that end an open paragraph.
BREAKS = frozenset("p li h1 h2 h3 h4 h5 h6 div ul ol table section article footer nav aside".split())
FURNITURE = frozenset("head nav footer aside form button select option menu dialog canvas object audio video map datalist".split())
#: Words of class names, ids and roles that mark furniture.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments respond disqus reply replies footer copyright toolbar widget pagination pager search skip masthead complementary contentinfo".split()
)
COMMENT_WORDS = frozenset("comment comments respond disqus reply replies".split())
#: Words that may stand beside these in a name without telling what is in the element.
NEUTRAL_WORDS = frozenset("site page left right top bottom box list area bar link links item items wrap wrapper container inner outer block section primary secondary global small large".split())


# --- one page -------------------------------------------------------------------


class Element:
    """An open element: its ``vote`` for being furniture, the text in it, and whether it is dropped in the end."""

    __slots__ = ("chars", "dropped", "last", "own_main", "parent", "safe", "vote")

    def __init__(self, parent: Element | None, vote: str, own_main: bool) -> None:
        self.parent, self.vote, self.own_main = parent, vote, own_main
        self.chars, self.last, self.safe, self.dropped = 0, 0, False, False


class Region:
    """A part of a page: ``main`` if an article or main element is around it, or it is one (``own_main``)."""

    __slots__ = ("main", "own_main", "parent", "path")

    def __init__(self, path: int, parent: Region | None, own_main: bool) -> None:
        self.path, self.parent, self.own_main = path, parent, own_main
        self.main = own_main or parent is not None and parent.main


@lru_cache(1 << 16)
def below(path: int, label: str) -> int:
    """Signed 64-bit name of an element, or of a block of text, in the element ``path``."""
    return xxhash.xxh64_intdigest(f"{path}/{label}".encode("utf-8", "surrogatepass")) - (1 << 63)


def token(path: int, text: str) -> int:
    """The name of a block of text; that of an element is its path."""
    return xxhash.xxh64_intdigest(f"{path}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63) if text else path


def _attributes(attributes: str) -> dict[str, str]:
    return {name.lower(): a or b or c for name, a, b, c in reversed(ATTRIBUTE.findall(attributes))}


@lru_cache(1 << 12)
def _pieces(name: str) -> frozenset[str]:
    """The words of one class name, id or role."""
    return frozenset(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())) - {""}


def _label(name: str, attributes: str) -> str:
    """The element's name with its class names; long numbers in these (ids of posts) count alike."""
    if "class" in attributes:
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            if key.lower() == "class":
                return f"{name}.{re.sub('[0-9]{3,}', '0', ' '.join((a or b or c).split()))}"
    return name


def _vote(name: str, attributes: str, main: bool) -> str:
    """``hidden``, ``name``, ``comment`` or ``word``: what an element gives itself out for; empty if for nothing.

    A class name, id or role counts if it has furniture words and no others
    but neutral ones: ``cookie-notice`` does, ``has-sidebar`` does not.  The
    header of an article is none.
    """
    if "=" not in attributes:
        if "hidden" in attributes.split():
            return "hidden"
    elif re.search("class|id|role|style|hidden", attributes, re.IGNORECASE):
        given = _attributes(attributes)
        if given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""), re.IGNORECASE) or "hidden" in ATTRIBUTE.sub(" ", attributes).split():
            return "hidden"
        if name not in ("html", "body"):
            for c in (x for key in ("class", "id", "role") for x in given.get(key, "").split()):
                words = _pieces(c)
                telling = words - NEUTRAL_WORDS
                if telling and telling <= FURNITURE_WORDS:
                    return "comment" if telling & COMMENT_WORDS else "word"
                if telling == {"header"} and not main:
                    return "name"
    return "name" if name in FURNITURE or name == "header" and not main else ""


def _decide(elements: list[Element]) -> None:
    """Which elements are dropped; ``elements`` has each after the one around it.

    Safe are the heaviest article or main element, those in it with half of its
    text or more, one in another, and all around these.  Of the others, those
    that are furniture by name, hidden or comments go; one that only its words
    speak against stays if it has most of the text of the main element it is in,
    or of the page; so does a form.
    """
    for k, e in enumerate(elements):
        e.last = k
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.last = max(e.parent.last, e.last)
    places = [k for k, e in enumerate(elements) if e.own_main]
    heart = 0
    inside = places
    while inside:
        heart = max(inside, key=lambda k: elements[k].chars)
        around: Element | None = elements[heart]
        while around is not None and not around.safe:
            around.safe = True
            around = around.parent
        inside = [k for k in inside if heart < k <= elements[heart].last and 2 * elements[k].chars >= elements[heart].chars]
    for k, e in enumerate(elements):
        if e.parent is not None and e.parent.dropped:
            e.dropped = True
        elif e.vote and not e.safe:
            scope = elements[heart] if heart <= k <= elements[heart].last else elements[0]
            e.dropped = e.vote in ("hidden", "name", "comment") or 2 * e.chars <= scope.chars


def blocks(page: str, regions: list[Region] | None = None) -> list[tuple[int, str, bool, Region, str]]:
    """``(path, name, furniture, region, text)`` of each element (text empty) and each block of text, in page order.

    Open elements are closed by the end of one around them, ``p`` and ``li``
    also by the next; the page may break off anywhere.  ``html`` and ``body``
    are left out of paths, as pages may leave them out.  ``regions`` gets the
    regions of the page, each after the one around it.
    """
    regions = [] if regions is None else regions
    regions.append(Region(0, None, False))
    elements = [Element(None, "", False)]
    stack: list[tuple[str, int, Element, Region]] = [("", 0, elements[0], regions[0])]  # name, path, element, region
    found: list[tuple[int, str, Element, Region, str]] = []
    open_names: Counter[str] = Counter()
    line: list[str] = []
    at = 0

    def flush() -> None:
        if line:
            text = SPACE.sub(" ", entities.unescape("".join(line))).strip()
            line.clear()
            if text:
                name, path, element, region = stack[-1]
                element.chars += len(text)
                found.append((path, name, element, region, text))

    while at < len(page):
        m = TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            line.append(page[at:end])
        if not m:
            break
        at = max(m.end(), end + 1)
        closing, name = m[1], (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                line.append(m[0][9:].removesuffix("]]>"))
            continue
        if name in RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if name in IN_LINE:
            continue
        vote = "" if closing else _vote(name, m[3], stack[-1][3].main)
        if name in INLINE and not vote:
            if closing and len(stack) > 1 and stack[-1][0] == name:
                flush()
                open_names[stack.pop()[0]] -= 1
            continue
        flush()
        if closing:
            if open_names[name]:
                while stack[-1][0] != name:
                    open_names[stack.pop()[0]] -= 1
                open_names[stack.pop()[0]] -= 1
            continue
        if name in BREAKS and (stack[-1][0] == "p" or name == "li" and stack[-1][0] == "li"):
            open_names[stack.pop()[0]] -= 1
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        _, around, parent, region = stack[-1]
        path = below(around, _label(name, m[3]))
        own_main = name in ("article", "main") or "role" in m[3] and "main" in _attributes(m[3]).get("role", "").lower().split()
        elements.append(Element(parent, vote, own_main))
        if own_main or name in REGIONS:
            region = Region(path, region, own_main)
            regions.append(region)
        stack.append((name, around if name in ("html", "body") else path, elements[-1], region))
        open_names[name] += 1
        found.append((path, name, elements[-1], region, ""))
    flush()
    _decide(elements)
    return [(path, name, e.dropped, region, text) for path, name, e, region, text in found]


class Page(NamedTuple):
    """What is kept of a page: its elements and its blocks of text that are no furniture, in page order, and its regions.

    ``places`` has the region of each token, ``heads`` the tokens that are main
    headings, ``around`` the region around each region (-1: none), and ``own_main``
    whether it is an article or main element.  The text of an element is empty.
    """

    tokens: list[int]
    places: list[int]
    texts: list[str]
    heads: list[int]
    parts: list[int]
    around: list[int]
    own_main: list[bool]


def read(page: str) -> Page:
    regions: list[Region] = []
    found = [b for b in blocks(page, regions) if not (b[4] and b[2])]
    number: dict[Region | None, int] = {None: -1} | {r: k for k, r in enumerate(regions)}
    return Page(
        [token(b[0], b[4]) for b in found], [number[b[3]] for b in found], [b[4] for b in found],
        [k for k, b in enumerate(found) if b[4] and b[1] == "h1"],
        [r.path for r in regions], [number[r.parent] for r in regions], [r.own_main for r in regions],
    )


def slots(page: str | Page, template: frozenset[int] = frozenset(), main_part: int | None = None, hinted: bool = False, small: frozenset[int] = frozenset()) -> str:
    """The text of the main slots of a page, blocks joined by one space.

    ``main_part`` is the path of the host's main region (0: the whole page);
    without one, or on a page that lacks it, an article or main element of the
    page itself is taken, and all of the page if it has none.  A main heading
    above the main part belongs to it.
    """
    if isinstance(page, str):
        page = read(page)
    n, found = len(page.parts), [(k, r, x) for k, (r, x) in enumerate(zip(page.places, page.texts, strict=True)) if x]
    slot = lambda chosen: " ".join(x for k, _, x in chosen if page.tokens[k] not in template)
    if main_part:
        inside, above, heads = [False] * n, [False] * n, frozenset(page.heads)
        for r, (path, around) in enumerate(zip(page.parts, page.around, strict=True)):
            inside[r] = path == main_part or around >= 0 and inside[around] and (hinted or path not in small)
            while path == main_part and around >= 0 and not above[around]:
                above[around] = True
                around = page.around[around]
        own = slot(b for b in found if inside[b[1]] or b[0] in heads and above[b[1]])
        if own or hinted and any(inside):
            return own
    main, beside = [False] * n, [True] * n  # in an article or main element; in none of the template's small regions
    for r, (path, around) in enumerate(zip(page.parts, page.around, strict=True)):
        main[r] = page.own_main[r] or around >= 0 and main[around]
        beside[r] = path not in small and (around < 0 or beside[around])
    return slot([b for b in found if main[b[1]]] or [b for b in found if beside[b[1]]])


# --- the template of a host ---------------------------------------------------------


def _hosts(pages: DataFrame, *columns: str) -> DataFrame:
    return pages.select(*columns, F.xxhash64(F.coalesce(host_of(F.col("url")), F.lit(""))).alias("host"))


PARSED = "name long, tokens array<long>, places array<int>, lengths array<int>, texts array<string>, heads array<int>, parts array<long>, around array<int>, own_main array<boolean>"


def parsed(rows: DataFrame, *kept: str) -> DataFrame:
    """``host`` and the columns ``kept`` of each row of ``rows`` (``host, html``), with what :func:`read` keeps of its html.

    ``name`` is a hash of the html, ``lengths`` are those of ``texts``.  All
    that follows reads this table, columns of it at a time: html is read and
    parsed once, and never shuffled.
    """
    columns = ["host", *kept]

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        htmls = [h or "" for h in batch.column(len(columns)).to_pylist()]
        found = [read(h) for h in htmls]
        yield {c: batch.column(k) for k, c in enumerate(columns)} | {c: [getattr(x, c) for x in found] for c in Page._fields} | {
            "name": [xxhash.xxh64_intdigest(h.encode("utf-8", "surrogatepass")) - (1 << 63) for h in htmls],
            "lengths": [[len(t) for t in x.texts] for x in found],
        }

    carried = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in columns)
    return map_texts(rows, [*columns, "html"], carried + PARSED, per_batch, rows=64)


def _lists(column: pa.ListArray) -> Iterator[list]:
    """The lists of a column, made of its values at once."""
    flat, at = column.flatten(), column.offsets.to_numpy()
    flat = flat.to_pylist() if pa.types.is_string(flat.type) or pa.types.is_boolean(flat.type) else flat.to_numpy().tolist()
    return (flat[a:b] for a, b in pairwise((at - at[0]).tolist()))


def tokens(rows: DataFrame) -> DataFrame:
    """``host, token, low, high, pages, times`` from pages (``host, html``) or what :func:`parsed` made of them.

    A token has the digest of its occurrence vector: two sums over pages of
    the halves of a hash of page and count, added up in each task first, then
    among tasks, in any order.  Text in furniture is no token.
    """

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        seen: dict[tuple[int, int], list[int]] = {}
        for host, name, toks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lists(batch.column(2)), strict=True):
            digests: dict[int, tuple[int, int]] = {}
            for t, n in Counter(toks).items():
                if n not in digests:
                    digest = xxhash.xxh64_intdigest(f"{name}:{n}")
                    digests[n] = digest & 0xFFFFFFFF, digest >> 32
                low, high = digests[n]
                at = seen.setdefault((host, t), [0, 0, 0, 0])
                at[0] += low
                at[1] += high
                at[2] += 1
                at[3] += n
        yield {"host": [h for h, _ in seen], "token": [t for _, t in seen]} | {
            c: [v[i] for v in seen.values()] for i, c in enumerate(("low", "high", "pages", "times"))
        }

    rows = parsed(rows) if "html" in rows.columns else rows
    parts = map_texts(rows, ["host", "name", "tokens"], "host long, token long, low long, high long, pages long, times long", per_batch)
    return parts.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("low", "high", "pages", "times")))


def classes(rows: DataFrame) -> DataFrame:
    """``host, token, class, pages``: the equivalence classes of frequent tokens.

    Classes of a host are numbered from 1, the root, which is the one on most
    pages (of these, the one that occurs least often, then the largest).
    """
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    common = tokens(rows).join(hosts, "host").filter((F.col("pages") >= CLASS_PAGES) & (F.col("pages") >= CLASS_SHARE * F.col("host_pages")))
    common = written(common, "common")
    vector = ["host", "low", "high", "pages", "times"]
    order = W.partitionBy("host").orderBy(F.desc("pages"), "times", F.desc("size"), "low", "high")
    found = common.groupBy(*vector).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= CLASS_TOKENS).withColumn("class", F.row_number().over(order))
    return common.join(found, vector).select("host", "token", "class", "pages", "host_pages")


def outlines(rows: DataFrame) -> DataFrame:
    """``host, kind, a, b, pages, low, high, x, y, tokens``: what the pages of a host say of its classes and regions.

    ``rows``: what :func:`parsed` gives, with ``known, numbers`` (tokens of the host and their classes).

    * ``root``: ``a`` a root token, ``low`` and ``high`` its places among root tokens, ``x`` its text, ``y`` all text of its pages.
    * ``class``: ``a`` a class, ``b`` the root token before it, ``low`` and ``high`` digests of its tokens in order (0: in none), ``x`` their text.
    * ``region``: ``a`` a region, ``low`` its depth, ``high`` 1 if it is an article or main element, ``x`` its text that is in no class.
    """

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        of_host: dict[int, dict[int, int]] = {}
        facts: dict[tuple, list] = {}

        def add(key: tuple, low: int, high: int, x: int, y: int, toks: tuple[int, ...] = ()) -> None:
            at = facts.setdefault(key, [0, low, high, 0, 0, toks])
            at[0] += 1
            at[1], at[2] = min(at[1], low), max(at[2], high)
            at[3] += x
            at[4] += y

        pages = zip(*(_lists(batch.column(k)) for k in range(3, batch.num_columns)), strict=True)
        for k, (toks, places, lengths, parts, around, own_main) in enumerate(pages):
            host = batch.column(0)[k].as_py()
            if host not in of_host:
                of_host[host] = dict(zip(batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), strict=True))
            known = of_host[host]
            root: list[tuple[int, int]] = []
            runs: dict[tuple[int, int], list[tuple[int, int]]] = {}
            chars, gap, total = [0] * len(parts), 0, sum(lengths)
            for t, r, n in zip(toks, places, lengths, strict=True):
                number = known.get(t)
                if number is None:
                    chars[r] += n
                elif number == 1:
                    root.append((t, n))
                    gap = t
                else:
                    runs.setdefault((number, gap), []).append((t, n))
            for place, (t, n) in enumerate(root):
                add((host, "root", t, 0), place, place, n, total)
            for (number, before), run in runs.items():
                cycle = tuple(dict.fromkeys(t for t, _ in run))
                times = len(run) // len(cycle)
                in_order = [t for t, _ in run] == list(cycle) * times
                digest = xxhash.xxh64_intdigest(repr(cycle).encode()) - (1 << 63) if in_order else 0
                add((host, "class", number, before), digest, digest, sum(n for _, n in run), total, cycle)
            for r in range(len(parts) - 1, 0, -1):
                chars[around[r]] += chars[r]
            sums: dict[int, list[int]] = {}
            depth = [0] * len(parts)
            for r, path in enumerate(parts):
                depth[r] = depth[around[r]] + 1 if r else 0
                sums.setdefault(path, [depth[r], own_main[r], 0])[2] += chars[r]
            for path, (deep, main, n) in sums.items():
                if n:
                    add((host, "region", path, 0), deep, int(main), n, 0)
        out = {c: [key[i] for key in facts] for i, c in enumerate(("host", "kind", "a", "b"))}
        yield out | {c: [v[i] for v in facts.values()] for i, c in enumerate(("pages", "low", "high", "x", "y", "tokens"))}

    schema = "host long, kind string, a long, b long, pages long, low long, high long, x long, y long, tokens array<long>"
    columns = ["host", "known", "numbers", "tokens", "places", "lengths", "parts", "around", "own_main"]
    parts = map_texts(rows, columns, schema, per_batch)
    sums = [F.sum(c).alias(c) for c in ("pages", "x", "y")]
    return parts.groupBy("host", "kind", "a", "b").agg(F.min("low").alias("low"), F.max("high").alias("high"), *sums, F.any_value("tokens").alias("tokens"))


def templates(pages: DataFrame) -> DataFrame:
    """``host, template, main_part, hinted, small``: one row for each host of pages (``url, html``), or what :func:`parsed` made of them, that has a template.

    ``template`` has the tokens of valid classes, elements and texts.  A host
    has at most some times the tokens of its pages' average, as each stands on
    a share of the pages.
    """
    rows = written(parsed(_hosts(pages, "html")), "blocks") if "html" in pages.columns else pages
    found = written(classes(rows), "classes")
    of_host = written(found.groupBy("host").agg(F.collect_list("token").alias("known"), F.collect_list("class").alias("numbers")), "known")
    facts = written(outlines(rows.join(of_host, "host")), "outlines")
    apart = F.col("low") == F.col("high")
    # a root token has one place on all pages; text that is most of its pages' text is a group of copies
    root = facts.filter((F.col("kind") == "root") & apart)
    weight = root.groupBy("host").agg((2 * F.sum("x") <= F.max("y")).alias("furnishes"))
    root = root.join(weight, "host").filter(F.col("furnishes") | (F.col("x") == 0)).select("host", F.col("a").alias("token"))
    on = found.select("host", F.col("class").cast("long").alias("a"), F.col("pages").alias("class_pages")).distinct()
    nested = facts.filter((F.col("kind") == "class") & apart & (F.col("low") != 0) & (F.size("tokens") >= CLASS_TOKENS) & (2 * F.col("x") <= F.col("y")))
    nested = nested.join(on, ["host", "a"]).filter(F.col("pages") == F.col("class_pages")).select("host", F.explode("tokens").alias("token"))
    valid = root.union(nested).distinct().groupBy("host").agg(F.collect_list("token").alias("template"))
    # regions by weight: those with most of the text stand in each other
    regions = facts.filter("kind = 'region'").join(found.groupBy("host").agg(F.max("host_pages").alias("host_pages")), "host")
    regions = regions.filter((F.col("pages") >= CLASS_PAGES) & (F.col("pages") >= CLASS_SHARE * F.col("host_pages")))
    whole = regions.filter("low = 0").select("host", F.col("x").alias("whole"))
    regions = regions.join(whole, "host")
    heavy, at = F.col("x") >= MAIN_SHARE * F.col("whole"), F.struct(F.col("low"), F.col("a"))
    parts = regions.groupBy("host").agg(
        F.min(F.when(heavy & (F.col("high") == 1), at)).alias("hint"), F.max(F.when(heavy, at)).alias("deepest"),
        F.collect_list(F.when(F.col("x") < SMALL_SHARE * F.col("whole"), F.col("a"))).alias("small"),
    )
    parts = parts.select("host", F.coalesce("hint", "deepest")["a"].alias("main_part"), F.col("hint").isNotNull().alias("hinted"), "small")
    return valid.join(parts, "host", "left")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages``.

    A null or empty html has an empty text.  Pages without a host share one
    template.  A host with fewer than CLASS_PAGES pages has none: its pages
    are read by their own article or main elements.  Repeated rows stay (and
    count as pages).  Other columns are not read.
    """
    rows = written(parsed(_hosts(pages, "page_id", "url", "html"), "page_id", "url"), "blocks")
    learned = written(templates(rows), "templates")  # small ones are broadcast by their size on disk
    schema = "page_id long, url string, text string, n_chars long"

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        of_host: dict[int, tuple] = {}
        texts = []
        for k, page in enumerate(zip(*(_lists(batch.column(c)) for c in range(7, batch.num_columns)), strict=True)):
            host = batch.column(2)[k].as_py()
            if host not in of_host:
                template, main_part, hinted, small = (batch.column(c)[k].as_py() for c in (3, 4, 5, 6))
                of_host[host] = frozenset(template or ()), main_part, bool(hinted), frozenset(small or ())
            texts.append(slots(Page(*page), *of_host[host]))
        yield {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    columns = ["page_id", "url", "host", "template", "main_part", "hinted", "small", *Page._fields]
    return map_texts(rows.join(learned, "host", "left"), columns, schema, per_batch, rows=64)
