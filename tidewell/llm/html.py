"""Operator 3, HTML extraction: wrappers by union-free regular-expression inference.

A page is a stream of tags and texts.  Streams of one host are aligned element by element: tokens at the same path of
labels (tag, classes, role) align.  A child that some of its parents lack becomes optional, one that a parent has several
times in a row becomes a repeated group, and a text that differs from page to page becomes a slot.  The result is a
union-free expression, the host's wrapper.  Merging two wrappers adds counts, takes maxima, and keeps a constant only if
both sides have it, so it is associative and commutative: pages may come in any order, in any number of partial wrappers,
and no page, host or token is left out.  Aligning by path takes one pass over the tokens.

The wrapper decides every page: its slots are marked, and a page yields the texts that meet marked slots, nothing else.
Slots below an element whose tag, role or class says menu, header, footer, sidebar, notice, advert, form or comments are
not marked.  Of the others, those inside article elements are the main text, unless the content elements (main, or a
container whose class says content) hold more than twice as much text over the whole host: then the articles are teasers
and the content is.  A page without the chosen kind falls back to the other one, then to all unmarked-out slots of the
body; of these, texts that are the same on at least half of the host's pages (and two pages at least) are template and
go, provided the slots that do differ hold a quarter of the text at least (else the pages are copies, not a template).

Each task folds its own pages; the partial wrappers of a host meet in two streaming steps.  Pages then meet the marks of
their host in one exchange, in which hosts with any share of the pages are cut into parts.

Defined cases: null or empty html gives the empty text.  Unclosed tags end with their parent or the page.  A page without
a host has a wrapper of its own.  Repeated rows are extracted alike.  Very long pages are read whole, one at a time.  An
empty table gives an empty result.  Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as _html
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .batches import slices
from .common import cut, salted, table

#: Wrapper nodes a task holds before it hands on what it has; it bounds memory only.
NODES = 200_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_CUT_TAGS = {"nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "object", "canvas", "audio", "video", "map", "datalist", "fieldset"}
_CUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form"}
#: What the last telling word of a class or id says is no part of an article.
_CUT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "masthead", "footer", "sidebar", "notice", "notices", "cookie", "search",
    "cookies", "consent", "gdpr", "comment", "comments", "disqus", "respond", "replies", "share", "sharing", "social", "related", "newsletter", "subscribe", "subscription", "popup", "modal", "overlay", "login", "signup", "widget", "widgets", "pagination", "pager", "toolbar",
}
#: Words that say where or how, not what: "footer-left" is a footer, "notice-period" is no notice.
_PLACE_WORDS = {"left", "right", "top", "bottom", "wrapper", "wrap", "container", "box", "area", "block", "section", "list", "inner", "outer", "bar", "links", "link", "items", "item", "buttons", "button", "icons", "form", "slot", "unit", "placeholder", "zone", "label", "main", "primary", "secondary", "panel", "group", "row", "col", "mobile", "desktop", "header", "footer", "title", "text"}
_CONTENT_WORDS = {"content", "article", "post", "entry", "story", "main"}
_FURTHER = {"posts", "articles", "stories", "content", "news", "reading"}
_CONTAINERS = {"div", "section", "td", "center"}
_IMPLIED = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_TOGETHER = [{"dd", "dt"}, {"td", "th"}]
#: Elements that may stand in a paragraph only as its end.
_ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SPLIT_CLASS = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
ARTICLE, CONTENT, BODY = "article", "content", "body"


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "") for m in _ATTR.finditer(text)} if text and len(text) > 1 else {}


def tokens(page: str):
    """(kind, name, attribute text or text): kind is "open", "close" or "text"; contents of raw elements are left out."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in _RAW and not m[3].endswith("/>"):
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            yield "close", name, ""


def _words(name: str) -> list[str]:
    return [w for w in _SPLIT_CLASS.split(_CAMEL.sub("-", name).lower()) if w and not w[0].isdigit()]


def _head(words: list[str]) -> list[str]:
    """Words up to the last telling one."""
    n = len(words)
    while n > 1 and words[n - 1] in _PLACE_WORDS:
        n -= 1
    return words[:n]


def says(name: str, vocabulary: set[str]) -> bool:
    """Whether a class or id names one of the vocabulary's things."""
    words = _words(name)
    head = _head(words)
    for w in (words, head):
        if w and (w[-1] in vocabulary or "".join(w[-2:]) in vocabulary):
            return True
    return vocabulary is _CUT_WORDS and len(head) > 1 and head[0] == "related" and head[-1] in _FURTHER


def describe(name: str, attrs: str) -> tuple[str, bool, bool, str | None]:
    """(label, cut, cut outside of articles, kind) of an element."""
    a = attributes(attrs) if len(attrs) > 2 else {}
    role = a.get("role", "").lower()
    classes = [c for c in (a.get("class", "") + " " + a.get("id", "")).split() if c]
    label = ".".join([name, *sorted({re.sub(r"\d+", "0", c) for c in classes})]) + (f"@{role}" if role else "")
    if name in ("html", "body"):
        return label.replace("/", "_"), False, False, None
    cut = name in _RAW or name in _CUT_TAGS or role in _CUT_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or any(says(c, _CUT_WORDS) for c in classes)
    header = name == "header" or any(says(c, {"header"}) for c in classes)
    kind = ARTICLE if name == "article" else CONTENT if name == "main" or role == "main" or (name in _CONTAINERS and any(says(c, _CONTENT_WORDS) for c in classes)) else None
    return label.replace("/", "_") + ("!" if "hidden" in a else ""), cut, header, kind


_DESCRIBED: dict[tuple[str, str], tuple] = {}


def _describe(name: str, attrs: str) -> tuple:
    key = (name, attrs)
    found = _DESCRIBED.get(key)
    if found is None:
        if len(_DESCRIBED) > 50_000:
            _DESCRIBED.clear()
        found = _DESCRIBED[key] = describe(name, attrs)
    return found


class _Open:
    __slots__ = ("name", "path", "cut", "article", "content", "children", "n")

    def __init__(self, name, path, cut, article, content):
        self.name, self.path, self.cut, self.article, self.content = name, path, cut, article, content
        self.children: dict[str, list[int]] = {}
        self.n = 0


def _hash(text: str) -> int:
    data = text.encode("utf-8", "replace")
    return zlib.crc32(data) << 31 | zlib.adler32(data) & 0x7FFFFFFF


# A wrapper is {path: node}; a path is its labels joined by "/", "#" for a text.  A node is a list:
PAGES, HOLDERS, TOTAL, MOST, ORDER, MASS, SAME, WHERE = range(8)
# pages and parents that have it, occurrences, most in one parent, sum of first places, characters, the hash of its text if
# that never differs (else None), and for texts where they stand: "article", "content", "both", "body" or "cut".


def read(page: str) -> tuple[list[tuple[str, str | None]], dict[str, list], set[str]]:
    """(items, wrapper of this page, kinds of elements that it has).  Items are (text, path); path None is a block boundary."""
    root = _Open("", "", False, False, False)
    stack, items, nodes, kinds = [root], [], {}, set()

    def place(parent: _Open, label: str, path: str) -> list:
        seen = parent.children.get(label)
        if seen is None:
            parent.children[label] = [1, parent.n]
        else:
            seen[0] += 1
        parent.n += 1
        node = nodes.get(path)
        if node is None:
            node = nodes[path] = [1, 0, 0, 0, 0, 0, None, ""]
        node[TOTAL] += 1
        return node

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            done = stack.pop()
            for label, (count, first) in done.children.items():
                node = nodes[f"{done.path}/{label}"]
                node[HOLDERS] += 1
                node[MOST] = max(node[MOST], count)
                node[ORDER] += first

    for kind, name, rest in tokens(page):
        top = stack[-1]
        if kind == "text":
            if top.cut:
                continue
            flat = " ".join(rest.split())
            path = top.path + "/#"
            items.append((rest, path))
            if flat:
                fresh = path not in nodes
                node = place(top, "#", path)
                node[MASS] += len(flat)
                h = _hash(flat)
                node[SAME] = h if fresh or node[SAME] == h else None
                node[WHERE] = "both" if top.article and top.content else ARTICLE if top.article else CONTENT if top.content else BODY
        elif kind == "close":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    close(i)
                    break
            if name not in _INLINE:
                items.append(("", None))
        else:
            label, cuts, header, sort = _describe(name, rest)
            inline = name in _INLINE
            if inline and not cuts:
                continue
            items.append(("", None))
            if name in _VOID:
                if not top.cut:
                    place(top, label, f"{top.path}/{label}")
                continue
            if name in _ENDS_P and top.name == "p":
                close(len(stack) - 1)
            elif name in _IMPLIED:
                same = next((g for g in _TOGETHER if name in g), {name})
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in same:
                        close(i)
                        break
                    if stack[i].name in _IMPLIED[name]:
                        break
            top = stack[-1]
            path = f"{top.path}/{label}"
            off = top.cut or cuts or (header and not top.article)
            if not off:
                if sort:
                    kinds.add(sort)
            if not top.cut:
                place(top, label, path)[WHERE] = "cut" if off else ""
            if not rest.endswith("/>") or name in _RAW:
                stack.append(_Open(name, path, off, top.article or sort == ARTICLE, top.content or sort == CONTENT))
    close(0)
    return items, nodes, kinds


def merge(a: dict[str, list], b: dict[str, list]) -> dict[str, list]:
    """Two wrappers as one; a is changed."""
    for path, n in b.items():
        m = a.get(path)
        if m is None:
            a[path] = list(n)
            continue
        for i in (PAGES, HOLDERS, TOTAL, ORDER, MASS):
            m[i] += n[i]
        m[MOST] = max(m[MOST], n[MOST])
        m[SAME] = m[SAME] if m[SAME] == n[SAME] else None
    return a


def expression(w: dict[str, list]) -> str:
    """The wrapper as a regular expression over tokens: <tag>...</tag>, #TEXT for a slot, ? optional, + repeated, * both."""
    below: dict[str, list[str]] = {}
    for path in w:
        below.setdefault(path.rpartition("/")[0], []).append(path)

    def show(parent: str, instances: int) -> str:
        out = []
        for path in sorted(below.get(parent, []), key=lambda p: (w[p][ORDER] / max(1, w[p][HOLDERS]), p)):
            n, label = w[path], path.rpartition("/")[2]
            body = ("#TEXT" if n[SAME] is None else "text") if label == "#" else f"<{label}>{show(path, n[TOTAL])}"
            how = ("*" if n[MOST] > 1 else "?") if n[HOLDERS] < instances else ("+" if n[MOST] > 1 else "")
            out.append(f"({body}){how}" if how else body)
        return "".join(out)

    return show("", max((n[PAGES] for p, n in w.items() if p.count("/") == 1), default=0))


def mark(w: dict[str, list], pages: int) -> dict:
    """{"order": kinds to try, kind: paths of its marked slots} of a wrapper over so many pages."""
    texts = {p: n for p, n in w.items() if p.endswith("/#") and n[WHERE] in ("both", ARTICLE, CONTENT, BODY)}
    mass = lambda *where: sum(n[MASS] for n in texts.values() if n[WHERE] in where)
    template = {p for p, n in texts.items() if n[SAME] is not None and n[PAGES] >= 2 and 2 * n[PAGES] >= pages}
    if 4 * sum(texts[p][MASS] for p in template) > 3 * sum(n[MASS] for n in texts.values()):
        template = set()
    return {
        "order": [CONTENT, ARTICLE] if mass(CONTENT) > 2 * mass(ARTICLE, "both") else [ARTICLE, CONTENT],
        ARTICLE: [p for p, n in texts.items() if n[WHERE] in (ARTICLE, "both")],
        CONTENT: [p for p, n in texts.items() if n[WHERE] in (CONTENT, "both")],
        BODY: [p for p in texts if p not in template],
    }


def _load(marks: str) -> dict:
    m = json.loads(marks)
    return {k: v if k == "order" else set(v) for k, v in m.items()}


def apply(page: str, marks: dict | None = None) -> str:
    """The texts of a page that meet marked slots: references decoded, white space [\\x20\\x09-\\x0D]+ as one space, blocks joined
    by one space.  Without marks the page's own wrapper is marked."""
    items, nodes, kinds = read(page)
    if marks is None:
        marks = _load(json.dumps(mark(nodes, 1)))
    wanted = marks[next((k for k in marks["order"] if k in kinds), BODY)]
    text = "".join(" " if path is None or t.isspace() else _html.unescape(t) for t, path in items if path is None or path in wanted or t.isspace())
    return b" ".join(text.encode("utf-8", "replace").split()).decode()


def _folded(batches):
    """Rows (host, ..., pages, wrapper) sorted by host -> one row a host; holds one wrapper at a time."""
    host, pages, held = None, 0, {}

    def out():
        return pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([pages], pa.int64()), pa.array([json.dumps(held)], pa.string())], names=["host", "pages", "wrapper"])

    for b in batches:
        for h, n, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if h != host:
                if host is not None:
                    yield out()
                host, pages, held = h, 0, {}
            pages += n
            merge(held, json.loads(w))
    if host is not None:
        yield out()


_WRAPPER = "host string, pages long, wrapper string"


def infer(pages: DataFrame) -> DataFrame:
    """host, pages (rows), wrapper (JSON) from (host, html)."""
    ship(pages.sparkSession)

    def partial(batches):
        held: dict[str, list] = {}
        size = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([json.dumps(w) for _, w in held.values()], pa.string())], names=["host", "pages", "wrapper"])

        for batch in batches:
            for b in slices(batch, 1):
                for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    own = read(page or "")[1]
                    if host in held:
                        size -= len(held[host][1])
                        held[host][0] += 1
                        merge(held[host][1], own)
                    else:
                        held[host] = [1, own]
                    size += len(held[host][1])
                if size > NODES:
                    yield out()
                    held.clear()
                    size = 0
        yield out()

    parts = pages.mapInArrow(partial, _WRAPPER).withColumn("salt", F.spark_partition_id() % 64)
    some = parts.repartition("host", "salt").sortWithinPartitions("host", "salt").select("host", "pages", "wrapper").mapInArrow(_folded, _WRAPPER)
    return some.repartition("host").sortWithinPartitions("host").mapInArrow(_folded, _WRAPPER)


def marked(wrappers: DataFrame) -> DataFrame:
    """host, pages, marks (JSON) of (host, pages, wrapper)."""

    def run(batches):
        for b in batches:
            marks = [json.dumps(mark(json.loads(w), n)) for n, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(marks, pa.string())], names=["host", "pages", "marks"])

    return wrappers.mapInArrow(run, "host string, pages long, marks string")


def host_of():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, a row for every row of pages."""
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("host", F.nullif(host_of(), F.lit("")))
    marks = cut(marked(infer(rows.where("host is not null").select("host", "html"))), "marks")
    kind = rows.schema["page_id"].dataType
    left, right = salted(rows, marks, ["host"], "pages", rows.count(), F.xxhash64("page_id", "url"))
    none = lambda t: F.lit(None).cast(t)
    left = left.select("host", F.col("_tw_s").alias("part"), F.lit(1).alias("turn"), "page_id", "url", "html", none("string").alias("marks"))
    right = right.select("host", F.col("_tw_s").alias("part"), F.lit(0).alias("turn"), none(kind).alias("page_id"), none("string").alias("url"), none("string").alias("html"), "marks")
    # The marks of a host come right before its pages, once a part, rather than beside each page.
    met = left.unionByName(right).repartition("host", "part").sortWithinPartitions("host", "part", "turn")

    def run(batches):
        host, current = None, None
        for batch in batches:
            for b in slices(batch, 5):
                keep, texts = [], []
                for i, (h, turn, page, m) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist())):
                    if turn == 0:
                        host, current = h, _load(m)
                    else:
                        keep.append(i)
                        texts.append(apply(page, current if h is not None and h == host else None))
                own = b.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([own.column(3), own.column(4), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return met.mapInArrow(run, rows.select("page_id", "url").schema.add("text", "string"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


SQL: dict[str, str] = {}
