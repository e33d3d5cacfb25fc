"""Pages to nodes: flatten every document into one row per element.

One pass of a small tag reader per page, inside ``mapInArrow``. Everything that needs
more than one element at a time (text of a subtree, profiles, clusters, paths) is left
to DataFrame operators on the node table.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rowharvest import schemas

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
NOT_RENDERED = frozenset("head script style template title meta link base noscript datalist param rp source track".split())
SCOPE = frozenset("html table td th caption template button object applet marquee".split())
#: start tag -> (elements it closes, elements that stop the search)
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
SPACE = "\t\n\x0b\x0c\r \xa0"


class _Node:
    __slots__ = ("tag", "attrs", "parent", "children", "chunks", "tree", "host", "gone", "hidden", "start", "end", "cells")

    def __init__(self, tag, attrs, parent, tree, host=None):
        self.tag, self.attrs, self.parent, self.tree, self.host = tag, attrs, parent, tree, host
        self.children, self.chunks, self.start, self.end = [], [], 0, 0
        self.cells = 0 if parent is None else parent.cells + (parent.tag in ("td", "th", "caption"))
        style = attrs.get("style", "").replace(" ", "").lower()
        own = tag in NOT_RENDERED or "hidden" in attrs or "display:none" in style or "visibility:hidden" in style
        self.gone = own or (parent is not None and parent.gone)  # hidden with all that is inside it
        self.hidden = self.gone or self.transparent
        if parent is not None:
            parent.children.append(self)

    @property
    def transparent(self):
        """Zero opacity hides the element itself, not what is inside it."""
        return any(p in ("opacity:0", "opacity:0.0") for p in
                   self.attrs.get("style", "").replace(" ", "").lower().split(";"))


class _Reader(HTMLParser):
    """Builds the element trees of one document: the page itself, open shadow roots
    written as declarative templates, and ``srcdoc`` frames, each a tree of its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.trees: list[tuple[_Node, int]] = []
        self.marks: list[tuple] = []
        self._open_tree(None)

    def _open_tree(self, host, shadow=False):
        self.tree = len(self.trees)
        self.root = _Node("#root" if shadow else "html", {}, None, self.tree, host)
        self.trees.append(self.root)
        self.stack, self.formatting, self.inert = [self.root], [], 0
        self.body = self.root if shadow else None
        self.head = None

    # -- tree construction -------------------------------------------------------

    def _push(self, tag, attrs):
        node = _Node(tag, attrs, self.stack[-1], self.tree)
        if tag not in VOID:
            self.stack.append(node)
        return node

    def _in_scope(self, tag, extra=()):
        for node in reversed(self.stack):
            if node.tag == tag:
                return True
            if node.tag in SCOPE or node.tag in extra:
                return False
        return False

    def _pop_to(self, tag):
        while self.stack.pop().tag != tag:
            pass

    def _need_body(self):
        if self.body is None:
            del self.stack[1:]
            self.body = self._push("body", {})

    def _reopen_formatting(self):
        top = self.stack[-1]
        cells = top.cells + (top.tag in ("td", "th", "caption"))
        for at, node in enumerate(self.formatting):
            if node not in self.stack and node.cells == cells:
                self.formatting[at] = self._push(node.tag, node.attrs)

    def handle_starttag(self, tag, attrs):
        attrs = {k: v if v is not None else "" for k, v in reversed(attrs)}
        if self.inert:
            self.inert += tag == self.inert_tag
            return
        if tag in ("html", "head", "body"):
            self._document_part(tag, attrs)
            return
        if self.body is None:
            if tag in HEAD_ONLY:
                if self.head is None:
                    self.head = self._push("head", {})
                elif self.stack[-1] is self.root:
                    self.stack.append(self.head)
            else:
                self._need_body()
        if tag in CLOSES_P and self._in_scope("p"):
            self._pop_to("p")
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.stack.pop()
        if tag in IMPLIED_END:
            closes, stops = IMPLIED_END[tag]
            for at in range(len(self.stack) - 1, 0, -1):
                if self.stack[at].tag in stops or (self.stack[at].tag in SCOPE and self.stack[at].tag not in closes):
                    break
                if self.stack[at].tag in closes:
                    del self.stack[at:]
        if tag == "tr" and self.stack[-1].tag == "table":
            self._push("tbody", {})
        elif tag in ("td", "th") and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            if self.stack[-1].tag == "table":
                self._push("tbody", {})
            self._push("tr", {})
        if tag == "template":
            self._open_template(attrs)
            return
        if tag == "a":
            self._close_formatting("a")
        if tag not in CLOSES_P and tag not in IMPLIED_END and tag not in HEAD_ONLY and tag not in ("caption", "col", "colgroup"):
            self._reopen_formatting()
        node = self._push(tag, attrs)
        if tag in FORMATTING:
            same = [n for n in self.formatting if n.tag == tag and n.attrs == attrs]
            if len(same) >= 3:
                self.formatting.remove(same[0])
            self.formatting.append(node)
        if tag == "noscript":
            self.inert, self.inert_tag = 1, tag
        if tag == "iframe" and attrs.get("srcdoc"):
            self.marks.append(("frame", node))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _document_part(self, tag, attrs):
        if tag == "html":
            self.root.attrs = {**attrs, **self.root.attrs}
        elif tag == "head" and self.head is None and self.body is None:
            self.head = self._push("head", attrs)
        elif tag == "body":
            self._need_body()
            self.body.attrs = {**attrs, **self.body.attrs}

    def _open_template(self, attrs):
        host = self.stack[-1]
        if attrs.get("shadowrootmode") == "open":
            self.marks.append(("shadow", self.tree, self.root, self.stack, self.formatting, self.body, self.head))
            self._open_tree(host, shadow=True)
        else:
            self._push("template", attrs)
            self.inert, self.inert_tag = 1, "template"

    def _close_formatting(self, tag):
        for node in reversed(self.formatting):
            if node.tag == tag:
                self.formatting.remove(node)
                if node in self.stack and not any(
                        n.tag in SCOPE for n in self.stack[self.stack.index(node):]):
                    inner = self.stack[self.stack.index(node) + 1:]
                    if all(n.tag in FORMATTING or n.tag == "span" for n in inner):
                        del self.stack[self.stack.index(node):]
                    else:
                        self.stack.remove(node)
                return

    def handle_endtag(self, tag):
        if self.inert:
            self.inert -= tag == self.inert_tag
            if not self.inert and self.stack[-1].tag == tag:
                self.stack.pop()
            return
        if tag == "template" and self.tree and self.marks and self.marks[-1][0] == "shadow":
            _, self.tree, self.root, self.stack, self.formatting, self.body, self.head = self.marks.pop()
        elif tag == "head":
            if self.body is None:
                del self.stack[1:]
        elif tag in ("body", "html"):
            pass
        elif tag in FORMATTING:
            self._close_formatting(tag)
        elif tag == "p" and not self._in_scope("p"):
            self._need_body()
            self._push("p", {})
            self.stack.pop()
        elif tag in HEADINGS:
            found = next((n.tag for n in reversed(self.stack) if n.tag in HEADINGS or n.tag in SCOPE), None)
            if found in HEADINGS:
                self._pop_to(found)
        elif tag not in VOID and any(n.tag == tag for n in self.stack[1:]):
            table_part = tag in ("table", "tbody", "thead", "tfoot", "tr", "td", "th")
            if table_part or self._in_scope(tag):
                self._pop_to(tag)

    def unknown_decl(self, data):
        pass

    def parse_marked_section(self, i, report=1):
        """Marked sections mean nothing in HTML: skipped up to the next '>', like other bogus comments."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def handle_data(self, data):
        if self.inert:
            return
        if self.body is None and self.stack[-1].tag in ("html", "head"):
            if not data.strip():
                return
            self._need_body()
        if self.stack[-1].tag in ("table", "tbody", "thead", "tfoot", "tr") and not data.strip():
            return
        if data.strip() and self.stack[-1].tag not in ("script", "style", "title", "textarea"):
            self._reopen_formatting()
        node = self.stack[-1]
        node.chunks.append((data, len(node.children)))


#: Attribute of the root element of a page that could not be read to its end.
UNREAD = "data-unread"


def _read(html: str) -> list[_Node]:
    """All tree roots of a document; nested ``srcdoc`` documents are read in place.

    A document that stops the reader keeps what was read before, and its root says so.
    """
    reader = _Reader()
    try:
        reader.feed(html)
        reader.close()
    except (AssertionError, ValueError, RecursionError) as stopped:
        reader.trees[0].attrs[UNREAD] = f"{type(stopped).__name__}: {stopped}"[:200]
    roots = list(reader.trees)
    for mark in reader.marks:
        if mark[0] == "frame":
            inner = _read(mark[1].attrs["srcdoc"])
            inner[0].host = mark[1]
            roots.extend(inner)
    return roots


class _Text:
    """Length of the whitespace-collapsed, trimmed text between two offsets, without copying it."""

    def __init__(self, text: str):
        self.solid, self.rank = [], []
        shown, gap = 0, False
        for at, c in enumerate(text):
            if c in "\u200b\u200c\u200d\ufeff":
                continue
            if c.isspace():
                gap = True
                continue
            shown += 2 if gap and self.solid else 1
            gap = False
            self.solid.append(at)
            self.rank.append(shown)

    def length(self, start: int, end: int) -> int:
        first, last = bisect_left(self.solid, start), bisect_left(self.solid, end) - 1
        return self.rank[last] - self.rank[first] + 1 if last >= first else 0


def _flatten(page_id, url: str, html: str) -> Iterator[tuple]:
    base = url
    order, pre_of = [], {}
    roots = _read(html)
    for tree, root in enumerate(roots):
        todo = [(root, (), "", 1, 0, True)]
        while todo:
            node, ancestors, path, nth, idx, only = todo.pop()
            if node.tag != "#root":
                pre_of[id(node)] = pre = len(order)
                step = node.tag if only else f"{node.tag}[{nth}]"
                path = f"{path}/{step}" if path else step
                order.append((node, tree, ancestors, path, nth, idx))
                if node.tag == "base" and base == url and node.attrs.get("href"):
                    try:
                        base = urljoin(url, node.attrs["href"])
                    except ValueError:
                        pass
                ancestors = (*ancestors, pre)
            seen, total = {}, {}
            for child in node.children:
                total[child.tag] = total.get(child.tag, 0) + 1
            pending = []
            for at, child in enumerate(node.children):
                seen[child.tag] = seen.get(child.tag, 0) + 1
                pending.append((child, ancestors, path, seen[child.tag], at, total[child.tag] == 1))
            todo.extend(reversed(pending))

    # text positions: the chunks of a tree in document order
    chunks_of, position, texts = {}, 0, []
    for root in roots:
        walk = [(root, 0, 0)]
        while walk:
            node, at_child, at_chunk = walk.pop()
            if not at_child and not at_chunk:
                node.start = position
            while at_chunk < len(node.chunks) and node.chunks[at_chunk][1] <= at_child:
                raw = node.chunks[at_chunk][0]
                norm = raw if raw.isascii() else unicodedata.normalize("NFKC", raw)
                chunks_of.setdefault(id(node), []).append(
                    {"pos": position, "after": node.chunks[at_chunk][1], "txt": norm, "raw": None if norm == raw else raw})
                texts.append(norm)
                position += len(norm)
                at_chunk += 1
            if at_child < len(node.children):
                walk.append((node, at_child + 1, at_chunk))
                walk.append((node.children[at_child], 0, 0))
            else:
                node.end = position
    measure = _Text("".join(texts))

    last = list(range(len(order)))
    for pre in range(len(order) - 1, -1, -1):
        ancestors = order[pre][2]
        if ancestors:
            last[ancestors[-1]] = max(last[ancestors[-1]], last[pre])
    for pre, (node, tree, ancestors, path, nth, idx) in enumerate(order):
        attrs = node.attrs
        linked = "href" in attrs or "src" in attrs or "srcset" in attrs or node.tag == "html"
        yield (
            page_id, tree, pre_of.get(id(roots[tree].host), -1), pre, last[pre],
            ancestors[-1] if ancestors else -1, len(ancestors), idx, len(node.children), nth,
            node.tag, attrs.get("id"), attrs.get("class", "").split(), list(attrs.items()),
            chunks_of.get(id(node), []), measure.length(node.start, node.end), list(ancestors), path, node.hidden,
            url if linked else None, base if linked else None,
        )


#: Rows per output batch: bounds the Python memory of a task whatever the page size mix.
BATCH_ROWS = 20_000


def node_schema(page_id_type: T.DataType) -> T.StructType:
    kept = [T.StructField("page_id", page_id_type, True), *schemas.NODE.fields[1:]]
    return T.StructType(kept)


def page_nodes(pages: DataFrame) -> DataFrame:
    """One row per element of every page. ``pages`` needs page_id, url and html.

    Partition parallel, no shuffle, works on streams too; ``page_id`` may be any type.
    """
    schema = node_schema(pages.schema["page_id"].dataType)
    arrow = to_arrow_schema(schema)

    def parse(batches):
        rows = []
        for batch in batches:
            ids, urls, htmls = (batch.column(n) for n in ("page_id", "url", "html"))
            for at in range(batch.num_rows):
                html = htmls[at].as_py()
                if not html:
                    continue
                rows.extend(_flatten(ids[at].as_py(), urls[at].as_py() or "", html))
                if len(rows) >= BATCH_ROWS:
                    yield _to_batch(rows, arrow)
                    rows = []
        if rows:
            yield _to_batch(rows, arrow)

    return spread(pages.select("page_id", "url", "html")).mapInArrow(parse, schema)


def spread(pages: DataFrame) -> DataFrame:
    """Give every core a share when the input has fewer files than cores.

    Page rows are few and heavy, and a small table often is one file. Tables of more files are left as they are,
    without a shuffle, and so is all that does not come straight from files.
    """
    if pages.isStreaming:
        return pages
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(cores * 2) if 0 < len(pages.inputFiles()) < cores else pages


def _to_batch(rows, arrow: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(values), type=field.type) for values, field in zip(columns, arrow)], schema=arrow)


# -- text of elements -----------------------------------------------------------------


def text_of(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Text content of the target elements: ``targets`` (page_id, pre) plus ``text`` and ``raw_text``.

    The node table stores every piece of text once, on its own element. A subtree's text
    is put together here for the elements asked for only: an element without children has its own pieces, any other the pieces
    of the places up to its last descendant. ``text`` is NFKC form, ``raw_text`` the text as written.
    """
    wanted = targets.select("page_id", "pre").distinct()
    asked = nodes.select("page_id", "pre", "last", "chunks").join(wanted, ["page_id", "pre"])
    places = asked.where(F.col("last") > F.col("pre")).select(
        "page_id", F.col("pre").alias("target"), F.explode(F.sequence("pre", "last")).alias("pre"))
    pieces = nodes.where(F.size("chunks") > 0).select("page_id", "pre", "chunks").join(places, ["page_id", "pre"])
    joined = pieces.groupBy("page_id", F.col("target").alias("pre")).agg(F.array_sort(F.flatten(F.collect_list("chunks"))).alias("chunks"))
    silent = asked.where(F.col("last") > F.col("pre")).select("page_id", "pre").join(joined, ["page_id", "pre"], "left")
    whole = asked.where(F.col("last") == F.col("pre")).select("page_id", "pre", "chunks").unionByName(silent.select("page_id", "pre", "chunks"))
    return whole.select(
        "page_id", "pre", F.coalesce(F.array_join(F.transform("chunks", lambda c: c["txt"]), ""), F.lit("")).alias("text"),
        F.coalesce(F.array_join(F.transform("chunks", lambda c: F.coalesce(c["raw"], c["txt"])), ""), F.lit("")).alias("raw_text"))


def own_text(chunks="chunks"):
    """Whitespace-collapsed text directly inside an element."""
    from rowharvest.functions.values import collapse_space

    return collapse_space(F.array_join(F.transform(F.col(chunks), lambda c: c["txt"]), " "))
