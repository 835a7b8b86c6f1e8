"""HTML extraction with site template removal.

A page is parsed in one pass into elements. Three hashes describe an element: of its subtree with its text
(tags and text, no attributes), of its outline (the path of tags, classes and ids that leads to it, and
the outlines below it, without text) and of that path alone. Spark counts, for each host, the different
pages that hold each hash and the text below it. What recurs on many of a host's pages decides:

- a container path that holds half of the host's text carries the content;
- a subtree that recurs with its text is template and deleted, and so is a container outside the content
  whose outline recurs and holds little of the text (menus, adverts and footers whose words change).

The counts come first: on a page with an element on its host's content path they go over the whole page, and
what they delete no mark is asked about. Only what they leave open, all of it on hosts with few pages, the page's own
marks decide: its article, else its main element, and what is a menu, header, footer, sidebar, notice, advert, form or
comment section by its tag, role, class or id. On a host of many pages a container outside the content that recurs
with its text on many of them goes even if these are a small share.

Within the content paragraphs, headings and the like stay even if they recur (copies of an article,
common sentences); only generic containers go. A recurring subtree with over two thirds of the text
is content that was copied: it stays, and inside it only what is on more pages than itself goes. A page
that would lose all its text keeps its rarest part.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, materialize, small_batches
from .filter_cascade import url_parts

LEAST_PAGES, LEAST_SHARE = 5, 0.3
#: Of a host's text: the share that a content path has at least, and an outline of the template at most.
CONTENT_SHARE, SLOT_SHARE = 0.5, 0.25
#: A subtree outside the content also goes if it is on so many pages and on this share of the host's.
MANY_PAGES, MANY_SHARE = 100, 0.03
#: Kinds of hashes, told apart by the last two bits; SOME: subtrees on many pages, but on less than the usual share.
SUBTREE, OUTLINE, PATH, SOME = 0, 1, 2, 3
#: How an element is marked: by the word lists, or as one that never holds text to read.
LISTED, NO_TEXT = 1, 2

# Names of HTML elements and of what is not article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title xmp noembed noframes".split())
MUTE = frozenset("head noscript template svg canvas object audio video select button input".split())
MEDIA = frozenset("svg canvas object audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form label dialog menu fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section ul ol dl table figure details center".split())
WHOLE = frozenset(("html", "body"))
SLOTS = CONTAINERS | DROPPED | {"header", "address"}
CARRIERS = frozenset("article main div section center table tbody tr td form".split())
ENDS_P = BLOCK - {"body", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKED = frozenset(
    "ad ads adbox adsbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer comment comments disqus respond replies share sharing social related recommended widget widgets login signup search searchform "
    "pagination pager toolbar copyright skip hidden form contactform".split()
)
MARKED_OUTSIDE = frozenset("header masthead topbar".split())
PAIRS = frozenset({("site", "header"), ("page", "header"), ("side", "bar"), ("pop", "up"), ("sign", "up"), ("see", "also"), ("log", "in")})

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
QUOTED = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
DIGITS = re.compile(r"\d+")
ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


def mark_of(name: str, attrs: str, inside: bool) -> int:
    """Whether an element holds no text to read, or is page furniture by its tag, role, class or id; else 0."""
    if name in MUTE:
        return NO_TEXT
    if name in DROPPED or (name == "header" and not inside):
        return LISTED
    if not attrs or attrs.isspace():
        return 0
    if name in ("html", "body", "main") or (name == "article" and "comment" not in attrs.lower()):
        return 0
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
            return LISTED
        if key in ("class", "id"):
            words = [w for w in re.split(r"[^a-z]+", value) if w]
            if not MARKED.isdisjoint(words) or (not inside and not MARKED_OUTSIDE.isdisjoint(words)) or any(p in PAIRS for p in zip(words, words[1:])):
                return LISTED
    return 0


class Element:
    __slots__ = ("name", "key", "parts", "marked", "article", "hash", "outline", "path", "size", "clean")

    def __init__(self, name: str, key: str, marked: int, article: bool) -> None:
        self.name, self.key, self.marked, self.article = name, key, marked, article
        self.parts: list = []  # texts and elements in order
        self.hash = self.outline = self.path = 0
        self.size = self.clean = 0  # characters of text without white space, and those outside listed elements


def key_of(attrs: str) -> str:
    """Classes and id without their digits."""
    if not attrs or attrs.isspace():
        return ""
    return " ".join(DIGITS.sub("", m[2].strip("\"'")) for m in ATTR.finditer(attrs) if m[2] and m[1].lower() in ("class", "id"))


class Open:
    """The open elements, with the places of each name, so that no end tag has to search for its start tag."""

    def __init__(self, root: Element) -> None:
        self.stack = [root]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.articles: list[int] = []  # article and main elements
        self.inside = 0  # of those and role="main"

    def push(self, e: Element) -> None:
        at = len(self.stack)
        self.stack.append(e)
        self.places[e.name].append(at)
        if e.name in BLOCK:
            self.blocks.append(at)
        if e.name in ("article", "main"):
            self.articles.append(at)
        self.inside += e.article

    def close(self, upto: int, by: str = "") -> None:
        """Close all from the place ``upto``; a media element that lacks its end tag gives its text to the page."""
        while len(self.stack) > upto:
            e = self.stack.pop()
            at = len(self.stack)
            self.places[e.name].pop()
            if self.blocks and self.blocks[-1] == at:
                self.blocks.pop()
            if self.articles and self.articles[-1] == at:
                self.articles.pop()
            self.inside -= e.article
            if e.name in MEDIA and not (at == upto and e.name == by):
                e.marked = 0

    def last(self, names) -> int:
        """The innermost open element of one of the names, 0 if none."""
        return max([self.places[n][-1] for n in names if n in self.places and self.places[n]], default=0)

    def end_tag(self, name: str) -> None:
        if at := self.last((name,)):
            if name not in BLOCK and self.blocks and self.blocks[-1] > at:
                return
            if name not in ("body", "html", "article", "main") and self.articles and self.articles[-1] > at:
                return
            self.close(at, name)

    def implied_ends(self, name: str) -> None:
        if name in ENDS_P and self.blocks and self.stack[self.blocks[-1]].name == "p":
            self.close(self.blocks[-1])
        if name in SIBLINGS and (at := self.last(SIBLINGS[name])) > self.last(SCOPES[name]):
            self.close(at)


def parse(page: str) -> Element:
    """The tree of a page in linear time; missing end tags are implied, stray ones ignored, raw texts skipped.

    Once a quote in a tag is never closed, quotes no longer hide the end of a tag."""
    root = Element("", "", 0, False)
    open_ = Open(root)
    stack = open_.stack
    quotes = cdata = True
    at = 0
    while (lt := page.find("<", at)) >= 0:
        if lt > at:
            stack[-1].parts.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if cdata and page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt + 9)
            if cdata := end >= 0:
                stack[-1].parts.append(page[lt + 9 : end].replace("&", "&amp;"))
                at = end + 3
                continue
        m = TAG.match(page, lt)
        if m is None:
            if page.startswith(("<!", "<?"), lt) and (end := page.find(">", lt)) >= 0:
                at = end + 1
            else:
                stack[-1].parts.append("<")
                at = lt + 1
            continue
        name = m[1].lower()
        whole = QUOTED.match(page, m.end()) if quotes else None
        end = whole.end() if whole else page.find(">", m.end()) + 1
        if not end:
            at = lt
            break
        quotes = whole is not None
        attrs = page[m.end() : end - 1]
        at = end
        if page[lt + 1] == "/":
            open_.end_tag(name)
            continue
        if name in RAW:
            if not attrs.endswith("/"):
                closing = re.compile(f"</{name}", re.I | re.A).search(page, at)
                at = page.find(">", closing.end()) + 1 if closing else 0
                at = at or len(page)
            continue
        if name in VOID:
            stack[-1].parts.append(Element(name, "", NO_TEXT, False))
            continue
        open_.implied_ends(name)
        e = Element(name, key_of(attrs), mark_of(name, attrs, open_.inside > 0), name in ("article", "main") or 'role="main"' in attrs)
        stack[-1].parts.append(e)
        if not attrs.endswith("/"):
            open_.push(e)
    stack[-1].parts.append(page[at:])
    open_.close(1)
    return root


def _kind(x: int, kind: int) -> int:
    return x >> 3 << 2 | kind


@cache
def _empty_hash(name: str) -> int:
    return xxhash.xxh64_intdigest(f"{name}\0")


def measure(root: Element) -> list[Element]:
    """Set hashes and sizes of every element that may hold text; those elements, children first."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        for x in e.parts:
            if isinstance(x, Element) and x.marked != NO_TEXT:
                x.path = xxhash.xxh64_intdigest(f"{e.path}\0{x.name}\0{x.key}")
                todo.append(x)
    order.reverse()
    for e in order:
        if not e.parts:
            e.hash, e.outline = _empty_hash(e.name), e.path
            continue
        said, below = [], set()
        for x in e.parts:
            if isinstance(x, str):
                words = x.split()
                said += words
                n = sum(map(len, words))
                e.size += n
                e.clean += n
            elif x.marked != NO_TEXT:
                said.append(f"\0{x.hash}")
                e.size += x.size
                e.clean += 0 if x.marked else x.clean
                if x.name in BLOCK:
                    below.add(x.outline)
        e.hash = xxhash.xxh64_intdigest(f"{e.name}\0{' '.join(said)}")
        e.outline = xxhash.xxh64_intdigest(f"{e.path}\0{sorted(below)}")
    return order[:-1]


def named_hashes(elements: list[Element]) -> dict[int, int]:
    """The hashes of a page that Spark counts, with the characters of text below them."""
    out: dict[int, int] = {}
    for e in elements:
        if e.size:
            if e.name in BLOCK and e.name not in WHOLE:
                h = _kind(e.hash, SUBTREE)
                out[h] = out.get(h, 0) + e.size
            if e.name in SLOTS:
                h = _kind(e.outline, OUTLINE)
                out[h] = out.get(h, 0) + e.size
            if e.name in CARRIERS and (not e.marked or e.name == "form"):
                h = _kind(e.path, PATH)
                out[h] = out.get(h, 0) + e.size
    return out


def article_roots(root: Element, gone: set[int] = frozenset()) -> list[Element]:
    """The outermost articles that are neither marked nor deleted, else the outermost mains, else the whole page."""
    for names in (("article",), None):
        found, todo = [], [root]
        while todo:
            e = todo.pop()
            if e.article and (names is None or e.name in names):
                found.append(e)
            else:
                todo += [x for x in reversed(e.parts) if isinstance(x, Element) and not x.marked and id(x) not in gone]
        if found:
            return found
    return [root]


def _children(e: Element) -> list[Element]:
    return [x for x in e.parts if isinstance(x, Element) and x.marked != NO_TEXT]


def content_elements(root: Element, template: dict[int, int]) -> tuple[list[Element], set[int], set[int]]:
    """The outermost elements on a path that carries the host's content; by identity, they with all below them, and all above them."""
    tops: list[Element] = []
    found: set[int] = set()
    above: set[int] = set()
    parent: dict[int, Element] = {}
    todo = [(root, False)]
    while todo:
        e, inside = todo.pop()
        if not inside and e.name in CARRIERS and _kind(e.path, PATH) in template:
            inside = True
            tops.append(e)
            up = parent.get(id(e))
            while up is not None and id(up) not in above:
                above.add(id(up))
                up = parent.get(id(up))
        if inside:
            found.add(id(e))
        for x in _children(e):
            parent[id(x)] = e
            todo.append((x, inside))
    return tops, found, above


def template_parts(roots: list[Element], template: dict[int, int], explicit: bool, lists: bool) -> set[int]:
    """Subtrees to delete, by identity, on a page without an element on its host's content path."""
    size = (lambda e: e.clean) if lists else (lambda e: e.size)
    whole = sum(map(size, roots))
    gone, deleted = {}, 0
    todo: list[tuple[Element, int]] = [(r, 0) for r in roots]
    tops = {id(r) for r in roots}
    names = CONTAINERS if explicit else BLOCK - WHOLE
    while todo:
        x, least = todo.pop()
        n = template.get(_kind(x.hash, SUBTREE), 0)
        if n > least and x.name in names and id(x) not in tops:
            if 3 * size(x) <= 2 * whole:
                gone[id(x)] = n
                deleted += size(x)
                continue
            least = n
        elif n > least and x.name in WHOLE:
            least = n
        todo += [(p, least) for p in _children(x) if not (lists and p.marked)]
    return _but_rarest(gone) if deleted == whole else set(gone)


def _but_rarest(gone: dict[int, int]) -> set[int]:
    least = min(gone.values(), default=0)
    return {k for k, n in gone.items() if n > least}


def decided_parts(root: Element, template: dict[int, int], tops: list[Element], content: set[int], above: set[int]) -> set[int]:
    """Subtrees to delete, by identity, on a page with content. What holds the content stays; shares of text are those of
    the content for what lies in it, else those of the page."""
    core = sum(e.size for e in tops)
    inside, deleted = {}, 0
    gone: set[int] = set()
    todo: list[tuple[Element, int]] = [(root, 0)]
    while todo:
        x, least = todo.pop()
        n = template.get(_kind(x.hash, SUBTREE), 0)
        if id(x) in content:
            if n > least and x.name in CONTAINERS:
                if 3 * x.size <= 2 * core:
                    inside[id(x)] = n
                    deleted += x.size
                    continue
                least = n
        elif id(x) in above:
            least = max(least, n)
        else:
            slot = x.name in SLOTS and not x.article
            if (n > least and x.name in BLOCK and 3 * x.size <= 2 * root.size) or (slot and (_kind(x.hash, SOME) in template or _kind(x.outline, OUTLINE) in template)):
                gone.add(id(x))
                continue
        todo += [(p, least) for p in _children(x)]
    return gone | (_but_rarest(inside) if deleted == core else set(inside))


def open_text(root: Element, content: set[int], gone: set[int]) -> bool:
    """Whether text outside the content is left that the counts did not decide."""
    todo = [root]
    while todo:
        e = todo.pop()
        if id(e) not in content and id(e) not in gone and e.size:
            if any(isinstance(x, str) and x.strip() for x in e.parts):
                return True
            todo += _children(e)
    return False


def extract(page: str, template: dict[int, int] | None = None, lists: bool = True) -> str:
    """The page's text, as ``extract_counted`` gives it."""
    return extract_counted(page, template, lists)[0]


def extract_counted(page: str, template: dict[int, int] | None = None, lists: bool = True) -> tuple[str, int, int]:
    """The page's text, one line for each block, without what ``template`` (hash, number of pages) deletes
    and, unless ``lists`` is off, without what the page's own marks leave out; the number of subtrees that the
    template deletes, and of the marks (of elements, or of articles chosen) that decided what it left open."""
    root = parse(page)
    tops: list[Element] = []
    content: set[int] = set()
    gone: set[int] = set()
    roots, marks = [root], 0
    if template:
        measure(root)
        tops, content, above = content_elements(root, template)
    if tops:  # counts first
        gone = decided_parts(root, template, tops, content, above)
        if lists and open_text(root, content, gone):
            roots = article_roots(root, gone)
    else:
        if lists:
            roots = article_roots(root)
        if template:
            gone = template_parts(roots, template, roots[0] is not root, lists)
    if roots[0] is not root:
        marks = len(roots)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            blocks.append(text)
        line.clear()

    todo: list = [x for r in reversed(roots) for x in (None, r)]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(entities.unescape(x))
        elif x.name == "br":
            line.append(" ")
        elif x.marked == NO_TEXT or id(x) in gone:
            continue
        elif lists and x.marked and not (x.name == "form" and id(x) in content):
            marks += x.size > 0 or not template  # sizes are measured where there is a template
        else:
            parts = x.parts
            if x.name == "header" and lists:  # an article's own header gives its headings
                parts = [p for p in parts if isinstance(p, Element) and p.name in HEADINGS]
            if x.name in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(parts)
    flush()
    return "\n".join(blocks), len(gone), marks


def find_templates(pages: DataFrame, url_col: str, html_col: str, least_pages: int, least_share: float) -> DataFrame:
    """(__thost, __template): for each host the hashes that decide, with their numbers of pages.

    All are on at least ``least_pages`` pages and ``least_share`` of the host's pages, or, as SOME, on ``MANY_PAGES``
    and ``MANY_SHARE``. Pages of equal html count once. A page names each of its hashes once, so a host's list has at
    most 1 / MANY_SHARE times as many entries as its pages have hashes on average."""
    host, _ = url_parts(F.col(f"`{url_col}`"))
    some = pages.select(host.alias("host"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html")).where("host <> ''")
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, sizes, hashes, chars = [], [], [], []
            for page in b.column(1).to_pylist():
                elements = measure(root := parse(page))
                own = named_hashes(elements)
                prints.append(xxhash.xxh3_128_digest(page))
                sizes.append(root.size)
                hashes.append(list(own))
                chars.append(list(own.values()))
            arrays = [b.column(0), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(chars, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "page", "size", "hashes", "chars"])

    named = some.mapInArrow(run, "host string, page binary, size long, hashes array<long>, chars array<long>")
    distinct = materialize(named.dropDuplicates(["host", "page"]), "pages")
    each = distinct.select("host", F.explode(F.arrays_zip("hashes", "chars")).alias("x")).select("host", F.col("x.hashes").alias("h"), F.col("x.chars").alias("c"))
    counts = each.groupBy("host", "h").agg(F.count("*").alias("n"), F.sum("c").alias("c")).where(F.col("n") >= least_pages)
    sizes = distinct.groupBy("host").agg(F.count("*").alias("pages"), F.sum("size").alias("chars")).withColumnRenamed("host", "of_host")
    sizes, counts = materialize(sizes, "host_sizes"), materialize(counts, "subtrees")
    kind = F.col("h").bitwiseAND(F.lit(3))
    decides = (
        F.when(kind == SUBTREE, True)
        .when(kind == OUTLINE, F.col("c") * F.col("pages") <= SLOT_SHARE * F.col("chars") * F.col("n"))
        .otherwise(F.col("c") >= CONTENT_SHARE * F.col("chars"))
    )
    usual = F.col("n") >= least_share * F.col("pages")
    many = (kind == SUBTREE) & (F.col("n") >= MANY_PAGES) & (F.col("n") >= MANY_SHARE * F.col("pages"))
    shared = counts.join(sizes, F.col("host") == F.col("of_host")).where((usual & decides) | many).withColumn("h", F.when(usual, F.col("h")).otherwise(F.col("h").bitwiseOR(F.lit(SOME))))
    return materialize(shared.groupBy(F.col("host").alias("__thost")).agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("__template")), "templates")


def extract_text(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE
) -> DataFrame:
    """``pages`` without the html, with text, n_chars (its code points), n_template (subtrees that the host's counts
    delete) and n_marks (marks of the page that decided what the counts left open).

    Character references are decoded, white space in a block becomes one space, blocks are joined by
    line feeds in page order. Null and empty html gives an empty text. Pages with a null url or none
    with "://" have no host and no template. Very long and hostile html is parsed whole, in linear time. Repeated rows
    are extracted one by one but count as one page. An empty table stays empty. Input columns named like an output column are replaced.
    """
    templates = find_templates(pages, url_col, html_col, least_pages, least_share)
    host, _ = url_parts(F.col(f"`{url_col}`"))
    fields = [T.StructField("text", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_chars", "n_template", "n_marks")]]
    base = pages.drop(*[f.name for f in fields])
    columns = [c for c in base.columns if c != html_col]
    slim = pages.select(*[pages[f"`{c}`"] for c in columns], pages[f"`{html_col}`"].alias("__html"), host.alias("__host"))
    met = slim.join(templates, F.col("__host") == F.col("__thost"), "left").drop("__host", "__thost")

    def make():
        def run(htmls: pa.Array, hashes: pa.Array, numbers: pa.Array) -> list:
            found = [extract_counted(h.as_py() or "", dict(zip(t[0] or (), t[1] or (), strict=True))) for h, *t in zip(htmls, hashes.to_pylist(), numbers.to_pylist(), strict=True)]
            return [[x[0] for x in found], [len(x[0]) for x in found], [x[1] for x in found], [x[2] for x in found]]

        return run

    return append_columns(met, [F.col("__html"), F.map_keys("__template"), F.map_values("__template")], fields, make).drop("__html", "__template")
