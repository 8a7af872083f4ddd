"""Main text of pages through wrappers inferred per host.

A wrapper is a union-free regular expression over a host's pages, kept as a tree: elements,
text that is the same on all pages or a slot where it varies, optional parts, and repeated
groups.  It grows by alignment: neighbouring equal elements (or groups of two or three) fold
into a repeated one, a part that only one side has becomes optional, and texts that differ
become a slot.  Every page takes part; each task aligns its own pages of a host, and the
results are aligned again, in two rounds.

Two rules of a host follow: which texts at which places are template (by the share of the
pages with the enclosing part, counted exactly beside the wrapper, so that a page of another
layout does not matter), and, for pages that do not mark their article, the wrapper's element
that holds most varying text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivemill.llm.shared import staged

#: Share of the pages with a part that must have the same text in it, to call it template,
#: and the fewest pages that can show it: two pages may agree by chance.
TEMPLATE_SHARE = 0.8
TEMPLATE_PAGES = 3
#: Share of the varying text that an element must hold to be the main one.
MAIN_SHARE = 0.6
#: Longer texts are kept in wrappers as their digests.
TEMPLATE_CHARS = 200
#: Elements below this depth stand side by side in the tree; browsers do the same at a depth of 512.
DEPTH = 256
#: Parts of an element that a wrapper keeps: those on most pages, of these the longest.
PARTS_KEPT = 256
#: Counts of texts that a task holds before it gives them out.
HELD_COUNTS = 1 << 17
#: Partial wrappers of a host are aligned in so many groups first.
GROUPS = 32
#: Bytes of all hosts' rules that are broadcast; more are joined by shuffling.
BROADCAST_BYTES = 8 << 20

# Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
NOT_TEXT = frozenset(
    "script style head title noscript template iframe object svg math canvas audio video map form button select "
    "textarea input label nav menu aside footer dialog".split()
)
NOT_TEXT_OUTSIDE = frozenset(["header"])
# What words in class, id and role name parts that are not the article.
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner billboard breadcrumb breadcrumbs comment comments "
    "consent contentinfo cookie cookies copyright disqus feedback footer gdpr login menu menubar modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended "
    "related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription tags teaser toolbar tooltip widget widgets".split()
)
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS_OUTSIDE = frozenset("header masthead topbar".split())
# Which open elements a start tag ends, and what stops the search for them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
ENDS_PARAGRAPH = BLOCK - {"br", "body", "html", "title", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd", "legend", "summary"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?"
    # A tag that another one starts in, outside quotes, is text: so no stretch is searched more than three times.
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/<>]*)(?P<attributes>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element or a text (name ``#``), of a page or of a wrapper."""

    __slots__ = ("name", "marks", "hidden", "children", "text", "many", "optional", "pages", "chars", "named")

    def __init__(self, name: str, marks: tuple[str, ...] = (), hidden: bool = False, text: str | None = None):
        self.name, self.marks, self.hidden, self.text = name, marks, hidden, text
        self.children: list[Node] = []
        self.many = self.optional = False
        self.pages, self.chars = 1, len(text or "")
        self.named: tuple[str, ...] = ()  # the words that only the id has

    @property
    def sign(self) -> str:
        return ".".join((self.name, *self.marks))

    def pack(self) -> list:
        kids = [c.pack() for c in self.children]
        return [self.name, self.marks, self.text, self.many, self.optional, self.pages, self.chars, kids]

    @classmethod
    def unpack(cls, packed: list) -> Node:
        node = cls(packed[0], tuple(packed[1]), text=packed[2])
        node.many, node.optional, node.pages, node.chars = packed[3:7]
        node.children = [cls.unpack(c) for c in packed[7]]
        return node


def _attributes(source: str) -> tuple[tuple[str, ...], bool, tuple[str, ...]]:
    """The words of class, id and role; whether the element is hidden; the words that only the id has."""
    marks, hidden, named, others = [], False, [], set()
    if source.strip(" /\t\r\n\f"):
        for key, *values in _ATTRIBUTE.findall(source):
            key, value = key.lower(), unescape("".join(values))
            if key in ("class", "id", "role"):
                words = [w.lower() for w in _WORD.findall(value)]
                marks += words
                if key == "id":
                    named += words
                else:
                    others.update(words)
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                hidden = True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
    return tuple(dict.fromkeys(marks)), hidden, tuple(w for w in named if w not in others)


def parse(html: str) -> Node:
    """The tree of a page; tags that are left open or never opened are tolerated.

    Elements nested more than ``DEPTH`` deep stand side by side, in the order of their texts; one in a part that is
    left out is left out with it.  The time is linear in the page.
    """
    root = Node("#page")
    stack, at = [root], 0
    levels: defaultdict[str, list[int]] = defaultdict(list)  # where the open elements of a name are in the stack

    def attach(node: Node) -> None:
        if len(stack) <= DEPTH:
            stack[-1].children.append(node)
        else:
            node.hidden = node.hidden or _excluded(stack[-1], True)
            stack[DEPTH - 1].children.append(node)

    def add_text(raw: str, decode: bool = True) -> None:
        if not raw:
            return
        top = stack[-1]
        if len(stack) > DEPTH and stack[DEPTH - 1].children[-1] is not top:  # goes on behind a deeper element
            again = Node(top.name, top.marks, top.hidden)
            again.named = top.named
            stack[DEPTH - 1].children.append(again)
            stack[-1] = top = again
        top.children.append(Node("#", text=unescape(raw) if decode else raw))

    def close(names: set[str], stops: set[str]) -> None:
        innermost = max((levels[n][-1] for n in names if levels[n]), default=0)
        if innermost and innermost > max((levels[n][-1] for n in stops if levels[n]), default=0):
            for node in stack[innermost:]:
                levels[node.name].pop()
            del stack[innermost:]

    while found := _TOKEN.search(html, at):
        add_text(html[at : found.start()])
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            add_text(found["cdata"] or "", decode=False)
        elif found["end"]:
            if name == "p" and not levels["p"]:
                continue
            close({name}, {"article", "table"} - {name} if name not in ("html", "body") else set())
        else:
            if name in ENDS:
                close(*ENDS[name])
            if name in ENDS_PARAGRAPH:
                close({"p"}, {"article", "table", "td", "li", "div", "section", "blockquote"})
            marks, hidden, named = _attributes(found["attributes"])
            node = Node(name, marks, hidden)
            node.named = named
            attach(node)
            if name in RAW:
                end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            elif name not in VOID and not found["attributes"].rstrip().endswith("/"):
                levels[name].append(len(stack))
                stack.append(node)
    add_text(html[at:])
    return root


# --- wrappers ---------------------------------------------------------------------


def _fold(nodes: list[Node]) -> list[Node]:
    """Neighbours with equal signs, alone or in groups of two or three, as one repeated node."""
    out, i, signs = [], 0, [n.sign for n in nodes]
    while i < len(nodes):
        for period in (1, 2, 3):
            end = i + period
            while signs[end : end + period] == signs[i : i + period] and end + period <= len(nodes):
                end += period
            if end > i + period:
                break
        else:
            out.append(nodes[i])
            i += 1
            continue
        group = [_same(nodes[i + k : end : period]) for k in range(period)]
        if period == 1:
            node = group[0]
        else:
            node = Node(f"({' '.join(n.sign for n in group)})")
            node.children = group
            node.chars = sum(n.chars for n in group)
        node.many = True
        out.append(node)
        i = end
    return out


def _same(nodes: list[Node]) -> Node:
    """Nodes of one page with equal signs as one; the page counts once."""
    first = nodes[0]
    for other in nodes[1:]:
        first = align(first, other, same_page=True)
    return first


def _kept(nodes: list[Node]) -> list[Node]:
    """The parts that a wrapper keeps, in their order; it does not grow with the pages."""
    if len(nodes) <= PARTS_KEPT:
        return nodes
    best = sorted(range(len(nodes)), key=lambda i: (-nodes[i].pages, -nodes[i].chars, i))[:PARTS_KEPT]
    return [nodes[i] for i in sorted(best)]


def as_wrapper(page: Node) -> Node:
    """A page as a wrapper of its own; white space is no text."""
    out = Node(page.name, page.marks, text=page.text)
    out.children = _fold([as_wrapper(c) for c in page.children if c.name != "#" or c.text.strip()])
    if out.text is not None:
        out.text = " ".join(out.text.split())
        out.chars = len(out.text)
        if out.chars > TEMPLATE_CHARS:
            out.text = f"#{hashlib.sha256(out.text.encode(errors='surrogatepass')).hexdigest()}"
    else:
        out.chars = sum(c.chars for c in out.children)
        out.children = _kept(out.children)
    return out


def align(a: Node, b: Node, same_page: bool = False) -> Node:
    """One wrapper for what both match; their signs are equal.  A page counts once."""
    out = Node(a.name, a.marks, text=a.text if a.text == b.text else None)
    out.many, out.optional = a.many or b.many, a.optional or b.optional
    out.pages, out.chars = 1 if same_page else a.pages + b.pages, a.chars + b.chars
    left, right = a.children, b.children
    for x, y in _matches([n.sign for n in left], [n.sign for n in right]):
        if x is not None and y is not None:
            out.children.append(align(left[x], right[y], same_page))
        else:
            only = left[x] if x is not None else right[y]
            only.optional = True
            out.children.append(only)
    out.children = _kept(out.children)
    return out


def _matches(a: list[str], b: list[str]) -> Iterator[tuple[int | None, int | None]]:
    """A longest common subsequence, with what only one side has in between."""
    if a == b:
        yield from ((i, i) for i in range(len(a)))
        return
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            yield i, j
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and size[i + 1][j] >= size[i][j + 1]:
            yield i, None
            i += 1
        else:
            yield None, j
            j += 1


def expression(node: Node) -> str:
    """The wrapper in the notation of regular expressions, for reading."""
    if node.name == "#":
        inner = "#TEXT" if node.text is None else node.text
    elif node.name.startswith("("):
        inner = f"({''.join(map(expression, node.children))})"
    else:
        inner = f"<{node.sign}>{''.join(map(expression, node.children))}</{node.name}>"
    mark = {(True, True): "*", (True, False): "+", (False, True): "?"}.get((node.many, node.optional), "")
    return f"({inner}){mark}" if mark else inner


def _digest(place: str, text: str = "") -> int:
    """A signed 64-bit number for a text at a place, or for a place."""
    source = f"{place}\n{text}".encode(errors="surrogatepass")
    return int.from_bytes(hashlib.blake2b(source, digest_size=8).digest(), "big", signed=True)


def texts_of(page: Node) -> tuple[set[int], set[tuple[int, int]]]:
    """The places of a page, and its texts with the places they stand in, each once.

    A text between others in an element, such as a comma after a link, counts only where the
    page has one element at that place.
    """
    seen: Counter[str] = Counter()
    alone: set[tuple[str, str]] = set()
    mixed: set[tuple[str, str]] = set()

    def walk(node: Node, place: str) -> None:
        seen[place] += 1
        texts = [t for c in node.children if c.name == "#" and (t := " ".join(c.text.split()))]
        rest = len(texts) > 1 or any(c.name != "#" and c.name not in BLOCK for c in node.children)
        (mixed if rest and texts else alone).update((place, t) for t in texts)
        for child in node.children:
            if child.name != "#" and child.name not in NOT_TEXT and not child.hidden:
                walk(child, f"{place}/{child.sign}")

    walk(page, "")
    alone.update((place, t) for place, t in mixed if seen[place] == 1)
    return {_digest(p) for p in seen}, {(_digest(p), _digest(p, t)) for p, t in alone}


def varies(wrapper: Node) -> bool:
    """Whether a wrapper has a slot; else its pages are one page again and again."""
    return wrapper.name == "#" and wrapper.text is None or any(map(varies, wrapper.children))


def main_place(wrapper: Node) -> str | None:
    """The place of the main element."""

    def varying(node: Node) -> int:
        if node.name == "#":
            return node.chars if node.text is None else 0
        return 0 if _excluded(node, False) else sum(varying(c) for c in node.children)

    total, main, node, place = varying(wrapper), None, wrapper, ""
    while total:
        found = [(varying(c), c) for c in node.children if c.name != "#" and not c.many]
        most = max(found, key=lambda x: x[0], default=(0, None))
        if most[0] < MAIN_SHARE * total or most[1].name in ("p", "span", "b", "i", "em", "strong"):
            break
        node = most[1]
        place = place if node.name.startswith("(") else f"{place}/{node.sign}"
        main = place
    return main


# --- extraction -------------------------------------------------------------------


def _excluded(node: Node, inside: bool) -> bool:
    """Whether an element is no part of an article; ``inside``: it stands in one."""
    if node.name in NOT_TEXT or node.hidden or not inside and node.name in NOT_TEXT_OUTSIDE:
        return True
    if node.name in ("html", "body", "article", "main", "#page") and not {"comment", "comments", "reply"} & set(node.marks):
        return False
    named = set(node.named) if inside else set()
    if any(m in PARTS or not inside and m in PARTS_OUTSIDE for m in node.marks if m not in named):
        return True
    if not named & PARTS or node.name == "p" or node.name in HEADINGS:  # an id there is an anchor
        return False
    return named <= PARTS or bool(named & COMMENTS) or _mostly_links(node)


def _mostly_links(node: Node) -> bool:
    """Whether an element has no text, or at least half of it in links."""

    def chars(node: Node, link: bool) -> tuple[int, int]:
        if node.name == "#":
            n = len("".join(node.text.split()))
            return n, n if link else 0
        own = [chars(c, link or c.name == "a") for c in node.children if c.name not in NOT_TEXT]
        return sum(a for a, _ in own), sum(b for _, b in own)

    total, linked = chars(node, False)
    return 2 * linked >= total


def _articles(node: Node, place: str, main: str | None) -> Iterator[tuple[int, Node, str]]:
    """Elements that may hold the article, with their rank.

    An article within a part that its words exclude ranks with the body, so the longer text is taken.
    """
    for child in node.children:
        here = f"{place}/{child.sign}"
        if child.name == "#" or child.name in NOT_TEXT or child.hidden:
            continue
        if _excluded(child, False):
            if child.name != "article":
                yield from ((0, c, p) for _, c, p in _articles(child, here, None) if c.name == "article")
            continue
        if child.name == "article" or "articlebody" in "".join(child.marks):
            yield 3, child, here
            continue
        yield from _articles(child, here, main)
        if child.name == "main" or "main" in child.marks and child.name in ("div", "section"):
            yield 2, child, here
        elif here == main:
            yield 1, child, here
        elif child.name == "body":
            yield 0, child, here


def _blocks(node: Node, place: str, inside: bool, template: set[int], out: list[list[str]]) -> None:
    for child in node.children:
        here = f"{place}/{child.sign}"
        if child.name == "#":
            if not template or _digest(place, " ".join(child.text.split())) not in template:
                out[-1].append(child.text)
        elif not _excluded(child, inside):
            if child.name in BLOCK:
                out.append([])
            _blocks(child, here, inside, template, out)
            if child.name in BLOCK:
                out.append([])


def extract(html: str | None, known: dict | None = None) -> str:
    """The main text of a page; ``known``: the rules of its host."""
    if not html:
        return ""
    page, known = parse(html), known or {"template": [], "main": None}
    template = set(known["template"])
    found = list(_articles(page, "", known["main"])) or [(0, page, "")]
    for top in sorted({rank for rank, _, _ in found}, reverse=True):  # lower ones where the higher have no text
        best = ""
        for rank, node, place in found:
            if rank == top:
                blocks: list[list[str]] = [[]]
                _blocks(node, place, rank >= 2 or node.name == "article", template, blocks)
                text = "\n".join(line for b in blocks if (line := " ".join("".join(b).split())))
                best = max(best, text, key=len)
        if best:
            return best
    return ""


# --- on Spark ---------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """The host of a url, lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrapper of each host's pages of a task; how many pages have a place, or a text at a place."""
    wrappers: dict[str, Node] = {}
    counts: Counter[tuple[str, int, int | None]] = Counter()

    def counted() -> pa.RecordBatch:
        hosts, places, texts = zip(*counts, strict=True) if counts else ([], [], [])
        columns = [pa.array(hosts, pa.string()), pa.nulls(len(counts), pa.string()), *(pa.array(x, pa.int64()) for x in (places, texts, counts.values()))]
        counts.clear()
        return pa.RecordBatch.from_arrays(columns, names=["host", "wrapper", "place", "text", "n"])

    for batch in batches:
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parsed = parse(html)
            places, texts = texts_of(parsed)
            counts.update((host, p, None) for p in places)
            counts.update((host, *t) for t in texts)
            if len(counts) > HELD_COUNTS:
                yield counted()
            page = as_wrapper(parsed)
            wrappers[host] = align(wrappers[host], page) if host in wrappers else page
    yield counted()
    none = pa.nulls(len(wrappers), pa.int64())
    packed = pa.array([json.dumps(w.pack()) for w in wrappers.values()], pa.string())
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(wrappers), pa.string()), packed, none, none, none], names=["host", "wrapper", "place", "text", "n"]
    )


def _aligned(table: pa.Table) -> pa.Table:
    wrapper = None
    for packed in sorted(table.column("wrapper").to_pylist()):  # in an order of their own
        other = Node.unpack(json.loads(packed))
        wrapper = other if wrapper is None else align(wrapper, other)
    return pa.table({"host": table.column("host")[:1], "wrapper": [json.dumps(wrapper.pack())]})


def _partials(pages: DataFrame, url: str, html: str) -> DataFrame:
    usable = pages.where(F.length(html) > 0).select(host_of(pages[url]).alias("_host"), html)
    return usable.mapInArrow(_partial, "host string, wrapper string, place bigint, text bigint, n bigint")


def _wrappers(partial: DataFrame) -> DataFrame:
    schema = "host string, wrapper string"
    partial = partial.where(F.col("wrapper").isNotNull()).select("host", "wrapper")
    grouped = partial.withColumn("group", F.pmod(F.xxhash64("wrapper"), F.lit(GROUPS)))
    once = grouped.groupBy("host", "group").applyInArrow(_aligned, schema)
    return once.groupBy("host").applyInArrow(_aligned, schema)


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The wrapper of every host: host and wrapper (JSON).  Pages without html take no part."""
    return _wrappers(_partials(pages, url, html))


def _templates(partial: DataFrame) -> DataFrame:
    """The template texts of every host that has some: host and an array of digests."""
    counts = partial.where(F.col("place").isNotNull())
    places = counts.where(F.col("text").isNull()).groupBy("host", "place").agg(F.sum("n").alias("pages"))
    texts = counts.where(F.col("text").isNotNull()).groupBy("host", "place", "text").agg(F.sum("n").alias("n"))
    often = texts.where(F.col("n") >= TEMPLATE_PAGES).join(places, ["host", "place"])
    often = often.where(F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    return often.groupBy("host").agg(F.sort_array(F.collect_set("text")).alias("template"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Every page's ``key``, ``url``, text and n_chars (code points).

    A null or empty html has the empty text; pages without a host share the wrapper of the
    empty host; repeated rows come back each; whole pages count; an empty table gives no rows;
    other columns are not read.  Any nesting and any unclosed tags or quotes are taken (``parse``).
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = []
            for packed, template in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                wrapper = Node.unpack(json.loads(packed))
                known.append(json.dumps({"template": template or [] if varies(wrapper) else [], "main": main_place(wrapper)}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known, pa.string())], names=["_host", "_rules"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            texts = [extract(source, json.loads(known) if known else None) for source, known in pairs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[key, url, "text", "n_chars"],
            )

    partial = staged(_partials(pages, url, html), "wrappers")
    both = _wrappers(partial).join(_templates(partial), "host", "left").select("host", "wrapper", "template")
    known = staged(both.mapInArrow(write, "_host string, _rules string"), "wrapper-rules")
    size = known.agg(F.sum(F.octet_length("_rules") + F.octet_length("_host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        known = F.broadcast(known)
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(key, url, html, host_of(pages[url]).alias("_host")).join(known, "_host", "left")
    return rows.select(key, url, html, "_rules").mapInArrow(run, f"`{key}` {kind}, `{url}` string, text string, n_chars bigint")
