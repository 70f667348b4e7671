"""Main text of web pages by wrapper induction.

A host's pages fall into layouts by the block elements and classes that they use. Each layout with at least
MIN_PAGES different pages has a reference, the first of its pages (smallest page_id) that reaches its end tag; pages of
rarer layouts, and of layouts whose pages are all cut off, take that of the host's commonest layout. Every page's tree is
aligned with its reference by simple tree matching: the largest set of matched node pairs that keeps parents and the
order of children. Over a host's different pages, a matched block whose text stays the same is template, one whose text
varies is a slot. A block is template where at least MIN_PAGES different pages of the host have it and SHARE of those
that have the node agree; or SHARE of those that have blocks of its tag path, so blocks that no reference has are judged too.

Of the slots, the main one is the lowest tag path that holds MAIN_SHARE of the varying text of all the host's pages;
what lies outside (menus, adverts, footers, comments whose text varies) isn't content. Where the markup has an article
element, it settles which of several nested or rival slots is the main one. Inside, elements that HTML itself gives
another role (navigation, asides, forms, scripts) go, and so do slots that the markup names as adverts, notices or
comments, but only where the slot recurs on the host's pages: a name on a page or two is the article's own.

Equal pages count once, so a much copied article is not taken for a template. A host of few pages has no template, and
its main slot is judged by those pages alone. Null or empty html gives an empty text. Pages without a host (null or odd
url) have one common, empty host. Markup may be cut off anywhere: open elements end there, and a cut tag is dropped.
Depth and number of elements are not bounded. Repeated rows give repeated results. Very long pages are parsed whole. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatspark.llm.stage import written

MIN_PAGES = 5
SHARE = 0.8
#: Reference pages up to this size in all are broadcast; more are joined by shuffle.
MAX_BROADCAST_BYTES = 32 << 20
MAX_BROADCAST_HOSTS = 500_000
#: Share of a host's varying text that its main slot holds, and share of its pages on which a named slot recurs.
MAIN_SHARE = 0.6
NAMED_SHARE = 0.2
#: Shapes and pairs that a reference's matcher keeps.
MAX_SOLVED = 200_000
#: Cells of an alignment table that are held at a time; larger ones are halved (Hirschberg).
ALIGN_CELLS = 1 << 22

#: Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button select textarea option iframe object svg canvas audio video dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog form menu menubar".split())
#: Words by which markup names menus, notices, adverts and comments within an article.
NAMED = frozenset("ad ads advert adverts advertisement banner comments cookie disqus menu nav newsletter notice promo related share sharing sidebar social sponsored subscribe".split())
#: Flags of tag paths.
ARTICLE, TITLE, NAMES, HOLDS = 1, 2, 4, 8
_NAME = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_CUT = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "inside")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def _close(self, tags, stop) -> None:
        node = self.at
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, {"td", "th", "li", "article", "section", "div", "button"})
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], {"ul", "ol", "dl", "table", "select"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("path", "circle", "rect", "use"):
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(_CUT.sub("", html))
    tree.close()
    return tree.root


def is_noise(node: Node) -> bool:
    """Whether the element's own name or role says that it isn't text of an article."""
    if node.tag in DROPPED or "hidden" in node.attrs or node.attrs.get("role", "").lower() in ROLES or node.attrs.get("aria-hidden") == "true":
        return True
    return node.tag == "header" and not node.inside


def elements(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node)]


def _post_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += elements(node)
    return out[::-1]


class Page:
    """A parsed page: its blocks in page order and the tree of its tag paths."""

    def __init__(self, root: Node):
        #: path of an element by id(): its ancestors' names and classes without digits, as a hash
        self.paths: dict[int, int] = {}
        #: path: (path of the parent, depth, flags)
        self.tree: dict[int, tuple[int | None, int, int]] = {}
        #: (element of the block, text)
        self.blocks: list[tuple[Node, str]] = []
        inline: list[str] = []

        def end(node):
            if inline:
                if text := " ".join("".join(inline).split()):
                    self.blocks.append((_block(node), text))
                inline.clear()

        self._place(root, None)
        stack: list[tuple[Node, int]] = [(root, 0)]
        while stack:
            node, i = stack.pop()
            if i < len(node.children):
                stack.append((node, i + 1))
                child = node.children[i]
                if isinstance(child, str):
                    inline.append(child)
                elif child.tag == "br":
                    inline.append(" ")
                elif not is_noise(child):
                    self._place(child, node)
                    if child.tag in BLOCKS:
                        end(node)
                    stack.append((child, 0))
            elif node.tag in BLOCKS:
                end(node)
        end(root)

    def _place(self, node: Node, parent: Node | None) -> None:
        up = self.paths[id(parent)] if parent else None
        names = _DIGITS.sub("", node.attrs.get("class", ""))
        path = self.paths[id(node)] = _number("path", up, node.tag, names)
        if path not in self.tree:
            flags = ARTICLE * (node.tag in ("article", "main") or node.attrs.get("role") in ("article", "main")) | TITLE * (node.tag == "h1")
            if node.tag in BLOCKS and not NAMED.isdisjoint(_NAME.findall(f"{names} {node.attrs.get('id', '')}".lower())):
                flags |= NAMES
            self.tree[path] = (up, self.tree[up][1] + 1 if up is not None else 0, flags)
        if node.tag in BLOCKS and parent and (parent.tag in BLOCKS or parent.parent is None):
            over, depth, flags = self.tree[up]
            self.tree[up] = (over, depth, flags | HOLDS)


def _block(node: Node) -> Node:
    while node.parent is not None and node.tag not in BLOCKS:
        node = node.parent
    return node


def number(root: Node) -> dict[int, int]:
    """Numbers of the nodes of a reference, in page order, by id(node)."""
    out, stack = {}, [root]
    while stack:
        node = stack.pop()
        out[id(node)] = len(out)
        stack += reversed(elements(node))
    return out


class Matcher:
    """Simple tree matching: the largest set of matched node pairs that keeps parents and the order of children.

    What two trees match in depends on their shapes alone, so pairs of shapes are solved once, the deepest first.
    """

    def __init__(self):
        self.shapes: dict[tuple, int] = {}
        self.kinds: dict[tuple, int] = {}
        self.kind: list[int] = []  # by shape
        self.kids: list[tuple[int, ...]] = []  # by shape
        self.depth: list[int] = []  # by shape
        self.solved: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def shape(self, root: Node) -> dict[int, int]:
        """Shapes of all nodes by id()."""
        out: dict[int, int] = {}
        for node in _post_order(root):
            kids = tuple(out[id(c)] for c in elements(node))
            kind = self.kinds.setdefault((node.tag, node.attrs.get("class")), len(self.kinds))
            out[id(node)] = n = self.shapes.setdefault((kind, kids), len(self.shapes))
            if n == len(self.kind):
                self.kind.append(kind)
                self.kids.append(kids)
                self.depth.append(1 + max((self.depth[k] for k in kids), default=0))
        return out

    def _size(self, x: int, y: int) -> int:
        """Size of the matching of two shapes whose children are solved; 0 for two kinds."""
        if self.kind[x] != self.kind[y]:
            return 0
        return self.solved[x, y][0] if self.kids[x] and self.kids[y] else 1

    def solve(self, x: int, y: int) -> None:
        wanted, stack = set(), [(x, y)]
        while stack:
            pair = stack.pop()
            if pair in wanted or pair in self.solved or self.kind[pair[0]] != self.kind[pair[1]] or not (self.kids[pair[0]] and self.kids[pair[1]]):
                continue
            wanted.add(pair)
            stack += [(a, b) for a in set(self.kids[pair[0]]) for b in set(self.kids[pair[1]])]
        for a, b in sorted(wanted, key=lambda p: self.depth[p[0]]):
            pairs = in_order(self.kids[a], self.kids[b], self._size)
            self.solved[a, b] = (1 + sum(self._size(self.kids[a][i], self.kids[b][j]) for i, j in pairs), pairs)

    def align(self, a: Node, b: Node, right: dict[int, int] | None = None) -> tuple[int, list[tuple[Node, Node]]]:
        """The size of the largest matching of two trees, and its pairs; `right`: the shapes of b, if known."""
        left, right = self.shape(a), right or self.shape(b)
        self.solve(left[id(a)], right[id(b)])
        size = self._size(left[id(a)], right[id(b)])
        out, stack = [], [(a, b)] if size else []
        while stack:
            x, y = stack.pop()
            out.append((x, y))
            if self.kids[left[id(x)]] and self.kids[right[id(y)]]:
                xs, ys = elements(x), elements(y)
                stack += [(xs[i], ys[j]) for i, j in self.solved[left[id(x)], right[id(y)]][1]]
        return size, out


def in_order(xs, ys, size) -> list[tuple[int, int]]:
    """Pairs (i, j), rising in both, with the largest sum of size(xs[i], ys[j]); 0 is no pair.

    The table has ALIGN_CELLS cells at most at a time; a larger one is halved (Hirschberg).
    """
    kinds, column = np.unique(np.asarray(ys), return_inverse=True)
    sizes = {x: np.array([size(x, k) for k in kinds.tolist()], np.int64)[column] for x in set(xs)}

    def rows(xi, low, high, step):
        last = np.zeros(high - low + 1, np.int64)
        yield last
        for i in xi:
            gain = last.copy()
            gain[1:] = np.maximum(last[1:], last[:-1] + sizes[xs[i]][low:high][::step])
            last = np.maximum.accumulate(gain)
            yield last

    def best(first, end, low, high):
        if first == end or low == high:
            return []
        if (end - first + 1) * (high - low + 1) > ALIGN_CELLS and end - first > 1:
            half = (first + end) // 2
            for head in rows(range(first, half), low, high, 1):
                pass
            for tail in rows(range(end - 1, half - 1, -1), low, high, -1):
                pass
            cut = low + int(np.argmax(head + tail[::-1]))
            return best(first, half, low, cut) + best(half, end, cut, high)
        table = np.array(list(rows(range(first, end), low, high, 1)))
        found, i, j = [], end - first, high - low
        while i and j:
            gain = int(sizes[xs[first + i - 1]][low + j - 1])
            if gain and table[i, j] == table[i - 1, j - 1] + gain:
                i, j = i - 1, j - 1
                found.append((first + i, low + j))
            elif table[i, j] == table[i - 1, j]:
                i -= 1
            else:
                j -= 1
        return found[::-1]

    return best(0, len(xs), 0, len(ys))


class Reference:
    """A reference page, to align pages with; its matcher keeps what it has solved."""

    def __init__(self, html: str):
        self.root = parse(html)
        self.numbers = number(self.root)
        self.matcher = Matcher()
        self.shapes = self.matcher.shape(self.root)

    def nodes(self, root: Node) -> dict[int, int]:
        """The reference's node of each matched node of a page, by id()."""
        if len(self.matcher.shapes) + len(self.matcher.solved) > MAX_SOLVED:
            self.matcher = Matcher()
            self.shapes = self.matcher.shape(self.root)
        return {id(x): self.numbers[id(y)] for x, y in self.matcher.align(root, self.root, self.shapes)[1]}


def _number(*parts) -> int:
    return int.from_bytes(hashlib.md5("\0".join(map(str, parts)).encode(errors="replace")).digest()[:8], "big", signed=True)


def _layout(html):
    """Hash of the block elements and classes that a page opens; numbers in classes don't count."""
    tags = "|".join(sorted(BLOCKS))
    opened = F.regexp_extract_all(html, F.lit(rf"(?i)<((?:{tags})(?=[\s>/])(?:[^<>]*?\sclass\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>]+))?)"), 1)
    kinds = F.transform(opened, lambda x: F.regexp_replace(F.lower(F.regexp_replace(x, r"(?is)^(\w+).*?\sclass\s*=\s*", "$1 ")), r"\d+", ""))
    return F.xxhash64(F.array_sort(F.array_distinct(kinds)))


def _references(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, layout, chosen) and (host, chosen, reference): the layout whose page a layout's pages are aligned with, and that page."""
    thin = rows.filter(F.length("html") > 0).select("host", "layout", "page_id", F.sha2("html", 256).alias("sha"), F.col("html").rlike(r"(?i)</html\s*>").alias("whole"))
    order = F.struct((~F.col("whole")).alias("cut"), "page_id", "sha")
    layouts = thin.groupBy("host", "layout").agg(F.count_distinct("sha").alias("n"), F.min(order).alias("first"), F.sum(F.col("whole").cast("long")).alias("whole"))
    layouts = written(layouts, "layouts")
    common = layouts.groupBy("host").agg(F.max_by("layout", F.struct("whole", "n", "layout")).alias("common"))
    own = (F.col("n") >= MIN_PAGES) & (F.col("whole") > 0)
    chosen = written(layouts.join(common, "host").select("host", "layout", F.when(own, F.col("layout")).otherwise(F.col("common")).alias("chosen"), F.col("first.page_id").alias("page_id"), F.col("first.sha").alias("sha")), "chosen")
    wanted = chosen.join(chosen.select("host", F.col("chosen").alias("layout")).distinct(), ["host", "layout"], "left_semi").select("host", "layout", F.col("page_id").alias("_page"), "sha")
    pages = rows.filter(F.length("html") > 0).withColumn("sha", F.sha2("html", 256))
    same = (pages["host"] == wanted["host"]) & (pages["layout"] == wanted["layout"]) & (pages["sha"] == wanted["sha"]) & pages["page_id"].eqNullSafe(wanted["_page"])
    found = pages.join(wanted, same).select(pages["host"], pages["layout"].alias("chosen"), F.col("html").alias("reference")).dropDuplicates(["host", "chosen"])
    return chosen.select("host", "layout", "chosen"), written(found, "references")


_BLOCKS = "array<struct<node:long,path:long,hash:long,text:string>>"
_TREE = "array<struct<path:long,parent:long,depth:int,flags:int>>"


def _packed(sizes: list[int], columns: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.Array:
    """A list array of structs from flat columns."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names))


def _rows(lists: pa.Array, *names: str) -> Iterator[list[list]]:
    """The columns of the structs of each list."""
    flat = lists.flatten()
    columns = [flat.field(n).to_pylist() for n in names]
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
    at = 0
    for n in sizes:
        yield [c[at : at + n] for c in columns]
        at += n


def _aligned(rows: DataFrame) -> DataFrame:
    """page_id, url, host, digest of the page, its blocks with the keys of their reference nodes and paths, and its tree of paths."""

    def run(batches):
        cache: dict[tuple, Reference] = {}
        for batch in batches:
            digests, sizes, flat, tree_sizes, trees = [], [], ([], [], [], []), [], ([], [], [], [])
            for host, chosen, html, reference in zip(*[batch[c].to_pylist() for c in ("host", "chosen", "html", "reference")]):
                html = html or ""
                digests.append(_number(html))
                if (host, chosen) not in cache:
                    if len(cache) >= 64:
                        cache.clear()
                    cache[host, chosen] = Reference(reference or "")
                root = parse(html)
                page, known = Page(root), cache[host, chosen].nodes(root)
                sizes.append(len(page.blocks))
                for n, t in page.blocks:
                    node = known.get(id(n))
                    for column, value in zip(flat, (None if node is None else _number("node", chosen, node), page.paths[id(n)], _number(t), t)):
                        column.append(value)
                tree_sizes.append(len(page.tree))
                for p, facts in page.tree.items():
                    for column, value in zip(trees, (p, *facts)):
                        column.append(value)
            blocks = _packed(sizes, flat, [pa.int64(), pa.int64(), pa.int64(), pa.string()], ["node", "path", "hash", "text"])
            tree = _packed(tree_sizes, trees, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["path", "parent", "depth", "flags"])
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], batch["host"], pa.array(digests, pa.int64()), blocks, tree], names=["page_id", "url", "host", "digest", "blocks", "tree"])

    return rows.select("page_id", "url", "host", "chosen", "html", "reference").mapInArrow(run, f"page_id long, url string, host string, digest long, blocks {_BLOCKS}, tree {_TREE}")


def _slots(judged: DataFrame) -> DataFrame:
    """(host, digest, path, depth, flags, chars): the varying text below each path of each page."""

    def run(batches):
        for batch in batches:
            hosts, digests, out = [], [], ([], [], [], [])
            trees, blocks = _rows(batch["tree"], "path", "parent", "depth", "flags"), _rows(batch["varying"], "path", "n")
            for host, digest, (path, parent, depth, flags), (at, n) in zip(batch["host"].to_pylist(), batch["digest"].to_pylist(), trees, blocks):
                chars = dict.fromkeys(path, 0)
                for p, k in zip(at, n):
                    chars[p] += k
                for i in sorted(range(len(path)), key=lambda i: -depth[i]):  # noqa: B023
                    if parent[i] is not None:
                        chars[parent[i]] += chars[path[i]]
                hosts += [host] * len(path)
                digests += [digest] * len(path)
                for column, values in zip(out, (path, depth, flags, [chars[p] for p in path])):
                    column += values
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((hosts, digests, *out), kinds)], names=["host", "digest", "path", "depth", "flags", "chars"])

    return judged.select("host", "digest", "tree", "varying").mapInArrow(run, "host string, digest long, path long, depth int, flags int, chars long")


def _wrappers(judged: DataFrame) -> DataFrame:
    """(host, main, named): the path of the host's main slot, and the named slots that recur on its pages.

    The main slot is the lowest with blocks in it that holds MAIN_SHARE of the varying text of the host's different pages. An element
    that the markup calls an article decides where several slots would do: one around the main slot, or else the
    one with the most varying text.
    """
    once = _slots(judged).dropDuplicates(["host", "digest", "path"])
    paths = written(once.groupBy("host", "path").agg(F.min("depth").alias("depth"), F.bit_or("flags").alias("flags"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("pages")), "paths")
    totals = paths.filter("depth = 0").groupBy("host").agg(F.sum("chars").alias("total"), F.max("pages").alias("every"))
    marked = paths.join(F.broadcast(totals) if totals.count() <= MAX_BROADCAST_HOSTS else totals, "host")
    flag = lambda f: F.col("flags").bitwiseAND(f) > 0
    article, holds = flag(ARTICLE), F.col("chars") >= MAIN_SHARE * F.col("total")
    names = flag(NAMES) & (F.col("pages") >= MIN_PAGES) & (F.col("pages") >= NAMED_SHARE * F.col("every"))
    by = F.struct("chars", -F.col("depth"), "path")
    return marked.groupBy("host").agg(
        F.coalesce(F.min_by("path", F.when(article & holds, F.struct("depth", "path"))), F.max_by("path", F.when(article & (F.col("chars") >= MAIN_SHARE / 2 * F.col("total")) & (F.col("chars") > 0), by)), F.max_by("path", F.when(holds & flag(HOLDS), F.struct("depth", "path")))).alias("main"),
        F.collect_list(F.when(names, F.col("path"))).alias("named"),
    )


def _texts(judged: DataFrame) -> DataFrame:
    """page_id, url, text: the varying blocks below the main slot, and a varying title before it."""

    def run(batches):
        for batch in batches:
            texts = []
            trees, blocks = _rows(batch["tree"], "path", "parent", "flags"), _rows(batch["varying"], "path", "text")
            for (path, parent, flags), (at, text), main, named in zip(trees, blocks, batch["main"].to_pylist(), batch["named"].to_pylist()):
                up = dict(zip(path, parent))
                gone, state = set(named or ()), {}

                def below(path):
                    """Whether the path is the main slot or in it, outside named slots."""
                    walk = []
                    while path is not None and path not in state:
                        walk.append(path)
                        if path == main:
                            state[path] = True
                            break
                        if path in gone:
                            state[path] = False
                            break
                        path = up[path]
                    found = state[path] if path is not None else False
                    for p in walk:
                        state[p] = found
                    return found

                if main not in up:  # a page that lacks its host's slot keeps all that varies
                    main = next((p for p, over in up.items() if over is None), None)
                inside = [below(p) for p in at]
                start = inside.index(True) if True in inside else len(inside)
                titles = {p for p, f in zip(path, flags) if f & TITLE}
                texts.append("\n".join(t for i, t in enumerate(text) if inside[i] or i < start and at[i] in titles))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return judged.select("page_id", "url", "tree", "varying", "main", "named").mapInArrow(run, "page_id long, url string, text string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))).withColumn("layout", _layout(F.col("html")))
    chosen, references = _references(rows)
    size = references.agg(F.sum(F.octet_length("reference"))).first()[0] or 0
    small = size <= MAX_BROADCAST_BYTES
    side = F.broadcast(references) if small else references
    aligned = written(_aligned(rows.join(chosen, ["host", "layout"], "left").join(side, ["host", "chosen"], "left")), "aligned")
    # A row without a hash for each path of a page counts the pages that have the path; a node occurs once a page.
    keys = F.array_distinct(F.flatten(F.transform("blocks", lambda b: F.array(F.struct(b["node"].alias("key"), b["hash"].alias("hash")), F.struct(b["path"].alias("key"), b["hash"].alias("hash")), F.struct(b["path"].alias("key"), F.lit(None).cast("long").alias("hash"))))))
    places = aligned.select("host", "digest", F.explode(keys).alias("k")).select("host", "digest", "k.key", "k.hash").filter("key is not null").distinct()
    same = written(places.groupBy("host", "key", "hash").agg(F.count(F.lit(1)).alias("n")), "counts")
    totals = same.groupBy("host", "key").agg(F.coalesce(F.max(F.when(F.col("hash").isNull(), F.col("n"))), F.sum("n")).alias("total"), F.max(F.when(F.col("hash").isNotNull(), F.col("n"))).alias("most")).filter(F.col("most") >= MIN_PAGES)
    agreed = same.filter((F.col("n") >= MIN_PAGES) & F.col("hash").isNotNull()).join(totals, ["host", "key"]).filter(F.col("n") >= SHARE * F.col("total"))
    template = written(agreed.groupBy("host").agg(F.collect_set(F.struct("key", "hash")).alias("template")), "template")
    if small:
        template = F.broadcast(template)
    known = lambda b, c: F.coalesce(F.array_contains("template", F.struct(b[c].alias("key"), b["hash"].alias("hash"))), F.lit(False))
    varying = F.transform(F.filter("blocks", lambda b: ~known(b, "node") & ~known(b, "path")), lambda b: F.struct(b["path"].alias("path"), F.length(b["text"]).alias("n"), b["text"].alias("text")))
    judged = aligned.join(template, "host", "left").select("page_id", "url", "host", "digest", "tree", varying.alias("varying"))
    thin = judged.select("host", "digest", "tree", F.transform("varying", lambda b: F.struct(b["path"].alias("path"), b["n"].alias("n"))).alias("varying"))
    wrappers = written(_wrappers(thin), "wrappers")
    if small:
        wrappers = F.broadcast(wrappers)
    return _texts(judged.join(wrappers, "host", "left")).withColumn("n_chars", F.length("text").cast("long"))
