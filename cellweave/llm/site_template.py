"""Main text of web pages: site templates are the element subtrees that recur across many pages of a host."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages

#: A subtree is the template's if it stands in so many different pages of its host.
LEAST_PAGES = 5
#: Template subtrees that are sent to every task at most; beyond, they are joined.
BROADCAST = 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that may be a template's subtree.
CONTAINER = frozenset("aside blockquote details dialog div dl fieldset figure footer form header menu nav ol section table ul".split())
DROPPED = frozenset("aside button datalist dialog footer form head input menu nav select svg template textarea".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id names that mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "notification popup modal newsletter sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar "
    "comment comments commentlist disqus respond replies".split()
)
#: What closes an open element of the name: a start of one of these.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAME = re.compile(r"[a-z0-9]+")


class Element:
    __slots__ = ("tag", "up", "marked", "hash", "depth", "cut", "held", "bad", "node")

    def __init__(self, tag: str, up: Element | None, attrs: dict[str, str]):
        self.tag, self.up = tag, up
        self.depth = up.depth + 1 if up else 0
        names = set(_NAME.findall((attrs.get("class", "") + " " + attrs.get("id", "")).lower()))
        role = attrs.get("role", "").lower()
        self.marked = tag in DROPPED or role in ROLES or bool(names & MARKS)
        if tag in ("html", "body", "main") or role == "main":
            self.marked = False
        if role == "main":
            self.tag = "main"
        self.hash = xxhash.xxh64(f"<{tag} {attrs.get('class', '')} {attrs.get('id', '')}>")


def parse(html: str) -> tuple[list[tuple[Element, str]], list[Element]]:
    """Blocks of text in page order, each with the element it stands in, and all elements, whose hashes cover their subtrees."""
    root = Element("html", None, {})
    stack, elements, blocks = [root], [root], []
    open_ = Counter({"html": 1})  # elements on the stack by name
    text: list[str] = []
    pos = 0

    def flush() -> None:
        if text:
            t = " ".join(unescape("".join(text)).split())
            text.clear()
            if t:
                blocks.append((at[0], t))
                e = at[0]
                while e.depth >= len(stack) or stack[e.depth] is not e:  # an element that is closed has given its hash on
                    e = e.up
                e.hash.update(t)
        at[0] = stack[-1]

    at = [root]

    def close(to: int) -> None:
        while len(stack) > to:
            e = stack.pop()
            open_[e.tag] -= 1
            stack[-1].hash.update(e.hash.digest())

    def add(s: str) -> None:
        if s:
            if not text:
                at[0] = stack[-1]
            elif stack[-1].depth < at[0].depth:  # text goes on after an inline element: it belongs to what holds both
                at[0] = stack[-1]
            text.append(s)

    for _ in iter(int, 1):
        m = _TAG.search(html, pos)
        if m is None:
            add(html[pos:])
            break
        add(html[pos : m.start()])
        pos = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, end, attrs = name.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if end:
            if tag in BLOCK:
                flush()
            if not open_[tag]:
                continue
            k = len(stack) - 1
            stop = {"article", "main", "body", "table", "section", "div"} if tag not in BLOCK else {"body"} if tag not in ("p", "li") else {"article", "main", "body"}
            while k > 0 and stack[k].tag != tag and name not in stop and stack[k].tag not in stop:
                k -= 1
            if k > 0 and stack[k].tag == tag:
                close(k)
            continue
        found = {}
        for a in _ATTR.finditer(attrs or ""):
            found.setdefault(a[1].lower(), unescape((a[2] or "").strip("\"'")))
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            flush()
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
            for k in range(len(stack) - 1, 0, -1):
                t = stack[k].tag
                if t in CLOSES.get(tag, ()):
                    close(k)
                elif t in SCOPE.get(tag, BLOCK):
                    break
        if tag == "body" or tag == "html":
            continue
        e = Element(tag, stack[-1], found)
        elements.append(e)
        if tag in RAW:
            over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(html, pos)
            e.hash.update(html[pos : over.start()])
            stack[-1].hash.update(e.hash.digest())
            pos = over.end()
        elif tag in VOID or (attrs or "").endswith("/") and tag not in BLOCK:
            pass
        else:
            stack.append(e)
            open_[e.tag] += 1
        if tag in BLOCK:
            at[0] = stack[-1]
    flush()
    close(1)
    return blocks, elements


def main_blocks(html: str) -> tuple[list[tuple[str, int]], list[tuple[int, int]], set[int], int]:
    """Candidate blocks of the main text, each with the subtree it stands in, or -1; those subtrees, each with the
    place of the next one that holds it, or -1; all subtrees that may be a template's; the main text's hash.

    The main text stands in the articles, all of them, else in the main elements, else in the page.
    """
    blocks, elements = parse(html)
    kinds = ("article", "main")
    for e in elements:  # what holds an element comes before it
        e.cut = e.marked or (e.up is not None and e.up.cut)
        e.held = dict(e.up.held) if e.up is not None and e.up.held else {}
        if e.tag in kinds and not e.cut:
            e.held.setdefault(e.tag, e)  # the outermost one
    kind = next((k for k in kinds if any(k in e.held for e, _ in blocks)), None)
    nodes: list[tuple[Element, int]] = []
    for e in elements:
        top = e.held.get(kind) is e
        above = e.up is None or top
        e.bad = False if top else (e.up is not None and e.up.bad) or e.marked or (kind is None and e.tag in ("header", "title"))
        e.node = -1 if above else e.up.node
        if not top and e.tag in CONTAINER:
            nodes.append((e, e.node))
            e.node = len(nodes) - 1
    out, name = [], xxhash.xxh64()
    used, kept = [False] * len(nodes), [False] * len(nodes)
    for e, t in blocks:
        good = (kind is None or kind in e.held) and not e.bad
        for seen in (used, kept) if good else (used,):
            k = e.node
            while k >= 0 and not seen[k]:
                seen[k] = True
                k = nodes[k][1]
        if good:
            out.append((t, e.node))
            name.update(t)
    signed = lambda e: e.hash.intdigest() - (1 << 63)
    place, trees = {-1: -1}, []
    for k, (e, up) in enumerate(nodes):
        if kept[k]:
            place[k] = len(trees)
            trees.append((signed(e), place[up]))
    return [(t, place[k]) for t, k in out], trees, {signed(e) for k, (e, _) in enumerate(nodes) if used[k]}, name.intdigest() - (1 << 63)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks and their subtrees as parallel lists; the html is the last column."""
    names = ["texts", "places", "trees", "ups", "seen", "main"]
    lists = [pa.list_(t) for t in (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64())]
    for b in batches:
        out: list[list] = [[] for _ in names]
        for html in b.column(b.num_columns - 1).to_pylist():
            blocks, trees, seen, name = main_blocks(html or "")
            for column, x in zip(out, ([t for t, _ in blocks], [k for _, k in blocks], [h for h, _ in trees], [u for _, u in trees], sorted(seen), name), strict=True):
                column.append(x)
        columns = [pa.array(x, t) for x, t in zip(out, [*lists, pa.int64()], strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], [*b.schema.names[:-1], *names])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(page_id, url, texts, places, trees, ups, gone)`` to the text of the blocks that stand in no subtree that goes."""
    for b in batches:
        out = []
        for texts, places, trees, ups, gone in zip(*(b.column(i).to_pylist() for i in range(2, 7)), strict=True):
            if gone:
                gone, bad = set(gone), []
                for h, up in zip(trees, ups, strict=True):
                    bad.append(h in gone or (up >= 0 and bad[up]))
                texts = [t for t, k in zip(texts, places, strict=True) if k < 0 or not bad[k]]
            out.append("\n".join(texts))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def main_text(pages: DataFrame, stages: Stages | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    Subtrees that stand in LEAST_PAGES or more different pages of a host, however large it is, are the template's and
    go; pages with the same main text count once, so copies of an article are no template.  What holds
    the article is never a template.  Navigation, headers, footers, asides, forms, notices, adverts and comments that
    vary from page to page, which no count of subtrees can tell, are known by element, role, class or id.  A page of
    template alone has no text.  A null html is empty; a null or hostless url belongs to the host without a name.  Repeated rows
    give repeated results.
    """
    stages = stages or Stages(pages.sparkSession, "template")
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    rows = pages.select("page_id", "url", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.xxhash64("page_id", "url", "html").alias("uid"), "html")
    parsed = rows.mapInArrow(_parse, f"{fields}, host string, uid long, texts array<string>, places array<int>, trees array<long>, ups array<int>, seen array<long>, main long")
    parsed = stages.save(parsed.withColumn("host", F.xxhash64("host")), "parsed")
    seen = parsed.select("host", "main", F.explode("seen").alias("tree")).distinct()
    template = seen.groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES).select("host", "tree")
    template = stages.save(template, "template")
    if template.count() <= BROADCAST:
        gone = F.broadcast(template.groupBy("host").agg(F.collect_list("tree").alias("gone")))
        joined = parsed.join(gone, "host", "left")
    else:
        hits = parsed.select("host", "uid", F.explode("trees").alias("tree")).join(template, ["host", "tree"], "left_semi").groupBy("uid").agg(F.collect_set("tree").alias("gone"))
        joined = parsed.join(hits, "uid", "left")
    out = joined.select("page_id", "url", "texts", "places", "trees", "ups", "gone").mapInArrow(_without, f"{fields}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
