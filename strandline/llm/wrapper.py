"""Main text of web pages by wrapper induction over pages of the same host.

A page becomes a tree in which runs of like siblings are folded into one node. The trees of
all layouts of a host are merged by simple tree matching: children of
two matched nodes are aligned so that the number of matched nodes in order becomes largest. Layouts are
merged one after another, the most frequent ones first; where a host has more than ``LAYOUTS``, that is done in groups of about so many, dealt by
the layouts' hashes, then with the groups' trees in the same way, until one is left. The
merged tree is the host's skeleton. Then every page of the host is aligned with it, and all
pages count: how many have a node, how many of them hold the same text there, how long texts are. A
node whose text is the same on ``CONSTANT`` of at least ``PAGES`` pages that have it is constant, and that text is template; nodes whose text
varies are slots, and the container that holds most of the varying text is where content stands. Copies
of a page count once, wherever they stand. Neither skeletons nor counts depend on how pages are partitioned.

A page's content is the host's content container,
widened to the article or else the main element around it, if there is one. Articles, else main elements,
inside the container are taken instead of all of it if they hold ``SHARE`` of its varying text. On hosts of
under ``PAGES`` pages content is the article, else the main element, else the page. What goes are template texts and menus,
headers, footers, sidebars, notices, adverts, forms, comments and the like, told
by element, role, class and id. A node that no skeleton has is not template.

Defined cases: a null or empty page has the empty text; text outside any element
counts as content; a null or odd url makes the host empty; pages may be nested as deeply as they like; repeated rows give repeated rows; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as markup
import re
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common, words

CONSTANT, PAGES = 0.6, 5
#: Trees that a task merges one after another; a host's other trees are merged by other tasks.
LAYOUTS = 64
#: Share of a node's varying text that makes a node below it the content container.
SHARE = 0.6
#: Bytes of all wrappers up to which they travel with the tasks; beyond that they are joined.
CARRIED = 16 << 20

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript".split())
SKIPPED = frozenset("head script style title textarea noscript template iframe svg canvas nav footer aside form button select dialog menu object audio video".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("html body table ul ol dl article section div td th main aside nav footer header".split())
#: Roles and words of classes and ids that mark what is not content.
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
MARKS = frozenset("nav navbar navigation menu footer sidebar aside ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup comment comments commentlist reply replies respond disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager widget toolbar skip".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*>", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "label", "skipped", "top", "parts", "at", "last")

    def __init__(self, tag: str, label: str, skipped: bool, top: bool):
        self.tag, self.label, self.skipped, self.top, self.parts = tag, label, skipped, top, []
        self.at = self.last = 0  # its place and that of its last descendant


def _opened(tag: str, attributes: str) -> Node:
    skipped, top, label = tag in SKIPPED, tag == "header", tag
    if attributes and not attributes.isspace():
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        named = f"{values.get('class', '')} {values.get('id', '')}".lower()
        own = _WORD.findall(named)
        role = values.get("role", "").lower()
        if own:
            label = f"{tag}.{own[0]}"
        style = values.get("style", "").replace(" ", "").lower()
        content = tag in ("article", "main", "body", "html")
        skipped = skipped or role in ROLES or (not content and not MARKS.isdisjoint(own)) or (tag == "article" and not {"comment", "comments", "reply"}.isdisjoint(own)) or "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in style
        top = top or "header" in own or "masthead" in own
        if role == "main":
            label = "main"
    return Node(tag, label, skipped, top)


def parse(page: str) -> Node:
    """The tree of a page; parts of a node are texts and nodes in order."""
    root = Node("", "", False, False)
    stack, at = [root], 0
    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        if close := m[1]:
            close = close.lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == close:
                    del stack[i:]
                    break
            else:
                if close == "p" or close == "br":
                    stack[-1].parts.append(" ")
        elif tag := m[2]:
            tag = tag.lower()
            if tag in CLOSES_P or tag in CLOSES:
                ends = ("p", *CLOSES.get(tag, ())) if tag in CLOSES_P else CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    t = stack[i].tag
                    if t in ends:
                        del stack[i:]
                        if t == "p" or tag == t:
                            break
                    elif t in SCOPES:
                        break
            node = _opened(tag, m[3])
            stack[-1].parts.append(node)
            if tag in RAW:
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            elif tag not in VOID and not m[3].endswith("/"):
                stack.append(node)
            elif tag not in VOID and tag in SKIPPED | BLOCKS:
                stack.append(node)  # a slash does not close such elements
    if at < len(page):
        stack[-1].parts.append(page[at:])
    return root


def _text(part: str) -> str:
    return markup.unescape(part) if "&" in part else part


def numbered(root: Node) -> None:
    """Give the nodes below ``root`` their places in page order."""
    count, stack = 0, [(root, iter(root.parts))]
    while stack:
        node, parts = stack[-1]
        for p in parts:
            if not isinstance(p, str):
                count += 1
                p.at = count
                stack.append((p, iter(p.parts)))
                break
        else:
            node.last = count
            stack.pop()


def _holds(node: Node, other: Node) -> bool:
    return node.at <= other.at <= node.last


# A tree node: [label, children, nodes of the page or number in the skeleton, own text]


def folded(root: Node) -> list:
    """The tree of a page, with runs of like siblings as one node."""
    out: list = []
    todo = [([root], out)]
    while todo:
        nodes, siblings = todo.pop()
        texts, below = [], []
        for n in nodes:
            for p in n.parts:
                if isinstance(p, str):
                    if not p.isspace():
                        texts.append(p)
                elif p.tag not in RAW:
                    below.append(p)
        own = [nodes[0].label, [], nodes, " ".join(texts)]
        siblings.append(own)
        runs: list[list[Node]] = []
        for p in below:
            if runs and runs[-1][0].label == p.label:
                runs[-1].append(p)
            else:
                runs.append([p])
        todo += [(run, own[1]) for run in runs[::-1]]
    return out[0]


def layout(tree: list) -> str:
    """Depths and labels in page order, a line each."""
    lines, todo = [], [(0, tree)]
    while todo:
        depth, node = todo.pop()
        lines.append(f"{depth} {node[0]}")
        todo += [(depth + 1, c) for c in node[1][::-1]]
    return "\n".join(lines)


def from_layout(text: str) -> list:
    """The tree of a layout; its nodes are numbered in order."""
    path: list = []
    for i, line in enumerate(text.split("\n")):
        depth, _, label = line.partition(" ")
        node = [label, [], i, ""]
        del path[int(depth) :]
        if path:
            path[-1][1].append(node)
        path.append(node)
    return path[0]


def _places(node: list, known: dict) -> dict[str, list[int]]:
    """Places of a node's children by label; ``known`` keeps them by the node's identity."""
    out = known.get(id(node))
    if out is None:
        out = known[id(node)] = {}
        for j, c in enumerate(node[1]):
            out.setdefault(c[0], []).append(j)
    return out


def _aligned(x: list, y: list, size: dict, places: dict) -> tuple[int, dict[int, list[tuple[int, int]]]]:
    """(most nodes that children of two nodes match in order, pairs of children by the nodes matched up to and with them).

    Only children of one label are looked at: ``upto`` are the places in ``y`` where the most matched nodes so far, ``most``, grow. A
    pair after others that match as much is not kept; :func:`matching` takes the first.
    """
    upto: list[int] = []
    most: list[int] = []
    ends: dict[int, list[tuple[int, int]]] = {}
    for i, c in enumerate(x[1]):
        found = []
        for j in places.get(c[0], ()):
            at = bisect_left(upto, j)
            found.append((j, size.get((id(c), id(y[1][j])), 1) + (most[at - 1] if at else 0)))
        for j, n in found:
            at = bisect_left(upto, j)
            if at and most[at - 1] >= n:
                continue
            past = bisect_right(most, n, at)
            if past == at and at < len(upto) and upto[at] == j:
                continue
            upto[at:past], most[at:past] = [j], [n]
            ends.setdefault(n, []).append((i, j))
    return (most[-1] if most else 0), ends


def matching(a: list, b: list, known: dict | None = None) -> tuple[dict, list[tuple[list, list]]]:
    """(number of matched nodes below and with two nodes, by their identities, if both have children, matched pairs) of two trees.

    ``known`` keeps places of children of ``b`` for further calls with the same tree.
    """
    known = {} if known is None else known
    pairs = [(a, b)] if a[0] == b[0] else []
    for x, y in pairs:
        places = _places(y, known)
        pairs += [(c, y[1][j]) for c in x[1] if c[1] for j in places.get(c[0], ()) if y[1][j][1]]
    size: dict[tuple[int, int], int] = {}
    for x, y in reversed(pairs):
        size[id(x), id(y)] = 1 + _aligned(x, y, size, _places(y, known))[0]
    out, todo = [], pairs[:1]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if not (x[1] and y[1]):
            continue
        n, ends = _aligned(x, y, size, _places(y, known))
        last, upto = len(x[1]), len(y[1])
        while n:
            last, upto = next((i, j) for i, j in ends[n] if i < last and j < upto)
            c, d = x[1][last], y[1][upto]
            todo.append((c, d))
            n -= size.get((id(c), id(d)), 1)
    return size, out


def merge(a: list, b: list) -> None:
    """Add to tree ``a`` what ``b`` has more, each in its place among matched siblings."""
    _, pairs = matching(a, b)
    partner = {id(y): x for x, y in pairs}
    for x, y in pairs:
        known = {id(c): i for i, c in enumerate(x[1])}
        children, at = [], 0
        for c in y[1]:
            if id(c) in partner:
                upto = known[id(partner[id(c)])] + 1
                children += x[1][at:upto]
                at = upto
            else:
                children.append(c)
        x[1] = children + x[1][at:]


def skeleton(layouts: list[str]) -> str:
    """The layout of the merged trees."""
    whole = from_layout(layouts[0])
    for text in layouts[1:]:
        merge(whole, from_layout(text))
    return layout(whole)


def text_name(text: str) -> int:
    """A number for a text; 0 for none."""
    own = text.encode()
    return zlib.crc32(own) << 31 | zlib.adler32(own) >> 1 or 1 if own else 0


class Wrapper:
    """A host's skeleton, and by node's number the pages that have it, those with its most frequent text, characters, and that text's name."""

    def __init__(self, text: str, counts: list[tuple[int, int, int, int, int]]):
        self.tree, self.places = from_layout(text), {}
        self.counts = {number: rest for number, *rest in counts}

    def pages(self, node: list) -> int:
        return self.counts.get(node[2], (0,))[0]

    def constant(self, node: list) -> bool:
        pages, top, *_ = self.counts.get(node[2], (0, 0))
        return pages >= PAGES and top >= CONSTANT * pages

    def template(self, node: list, text: str) -> bool:
        return self.constant(node) and self.counts[node[2]][3] == text_name(text)

    def varying(self, node: list) -> float:
        """Varying characters of a page that has the node, its own only."""
        pages, _, chars, *_ = self.counts.get(node[2], (0, 0, 0))
        return 0.0 if not pages or self.constant(node) else chars / pages


def template_nodes(own: list, wrapper: Wrapper) -> tuple[set[int], list[Node], dict[int, tuple[int, float]]]:
    """(identities of nodes whose own text is template, nodes of the content container, slots) of a page's tree.

    The slot of a node's identity is its number in the skeleton and the varying text below that.
    """
    _, pairs = matching(own, wrapper.tree, wrapper.places)
    slot = {id(p): t for p, t in pairs}
    fixed: set[int] = set()
    slots: dict[int, tuple[int, float]] = {}
    mass: dict[int, float] = {}
    for p, t in reversed(pairs):  # children come before their parents
        tag, _, name = t[0].partition(".")
        if wrapper.template(t, p[3]):
            fixed.update(map(id, p[2]))
        whole = wrapper.varying(t) + sum(mass.get(id(c), 0.0) for c in p[1])
        mass[id(p)] = 0.0 if tag in SKIPPED or name in MARKS or any(n.skipped for n in p[2]) else whole
        slots.update((id(n), (t[2], mass[id(p)])) for n in p[2])
    box = own
    while True:
        for p in box[1]:
            if id(p) in slot and mass[id(p)] >= SHARE * mass[id(box)] and mass[id(p)] and not any(n.skipped for n in p[2]) and any(c[0].partition(".")[0] in BLOCKS for c in slot[id(p)][1]):
                box = p
                break
        else:
            return fixed, box[2], slots


def _within(node: Node, want) -> list[Node]:
    """Topmost wanted nodes below ``node``, none from inside skipped ones."""
    out, todo = [], [node]
    while todo:
        own = todo.pop()
        if own is not node and want(own):
            out.append(own)
        elif own is node or not own.skipped:
            todo += [p for p in own.parts[::-1] if not isinstance(p, str)]
    return out


def _content(root: Node, box: list[Node], slots: dict[int, tuple[int, float]]) -> tuple[list[Node], bool]:
    """(nodes that hold the content, whether they are articles or main elements) of a page."""
    for want in (lambda n: n.tag == "article", lambda n: n.tag == "main" or n.label == "main"):
        found = _within(root, lambda n, want=want: want(n) and not n.skipped)
        if not box and found:
            return found, True
        around = [n for n in found if any(_holds(n, b) for b in box)]
        if around:
            return around, True
        below = [n for n in found if any(_holds(b, n) for b in box)]
        if below and sum(dict(slots[id(n)] for n in below if id(n) in slots).values()) >= SHARE * slots[id(box[0])][1]:
            return below, True
    return box or [root], False


def main_text(page: str, wrapper: Wrapper | None = None) -> str:
    """The text of the content blocks of a page, a line each."""
    root = parse(page)
    numbered(root)
    fixed: set[int] = set()
    box: list[Node] = []
    slots: dict[int, tuple[int, float]] = {}
    if wrapper is not None and wrapper.pages(wrapper.tree) >= PAGES:
        fixed, box, slots = template_nodes(folded(root), wrapper)
    found, inside = _content(root, box, slots)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(_text("".join(line)).split())
        line.clear()
        if text:
            blocks.append(text)

    for node in found:
        stack = [(node, iter(node.parts))]
        flush()
        while stack:
            node, parts = stack[-1]
            for p in parts:
                if isinstance(p, str):
                    if id(node) not in fixed:
                        line.append(p)
                elif p.tag == "br" or p.tag == "wbr":
                    line.append(" " if p.tag == "br" else "")
                elif not p.skipped and not (p.top and not inside):
                    if p.tag in BLOCKS:
                        flush()
                    stack.append((p, iter(p.parts)))
                    break
            else:
                if node.tag in BLOCKS:
                    flush()
                stack.pop()
        flush()
    return "\n".join(blocks)


_LAYOUT = pa.schema([("host", pa.string()), ("digest", pa.int64()), ("layout", pa.string())])


def _layouts(batches):
    """(host, digest, layout) of pages."""
    for batch in batches:
        found = [layout(folded(parse(page))) for page in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.string())], schema=_LAYOUT)


def _skeletons(key, rows):
    """(host, n, layout): the merged tree of a group of trees, the most frequent ones first, and the pages behind it."""
    times, texts = rows.column("n").to_pylist(), rows.column("layout").to_pylist()
    order = sorted(zip(times, texts, strict=True), key=lambda x: (-x[0], hashlib.md5(x[1].encode()).hexdigest()))
    return pa.table({"host": [key[0].as_py()], "n": [sum(times)], "layout": [skeleton([x for _, x in order])]})


def _merged(trees: DataFrame) -> DataFrame:
    """(host, skeleton) of all trees (host, n, layout) of a written table, group by group until each host has one."""
    while True:
        # groups become larger where there are so many trees that hosts with several groups could be too many to broadcast
        bound = max(LAYOUTS, trees.count() // common.BROADCAST_ROWS)
        sizes = trees.groupBy("host").agg(F.ceil(F.count("*") / bound).alias("groups"))
        groups, most = sizes.agg(F.sum("groups"), F.max("groups")).first()
        many = F.broadcast(sizes.where("groups > 1"))
        group = F.coalesce(F.pmod(F.xxhash64("layout"), F.col("groups")), F.lit(0))
        dealt = trees.join(many, "host", "left").select("host", group.alias("part"), "n", "layout")
        out = dealt.groupBy("host", "part").applyInArrow(_skeletons, "host string, n long, layout string")
        last, trees = trees, common.table(out, "skeletons", 7 + common.worth(groups or 0, 10))
        common.drop(last)
        if (most or 0) <= 1:
            return trees.select("host", F.col("layout").alias("skeleton"))


_COUNT = pa.schema([("host", pa.string()), ("digest", pa.int64()), ("node", pa.int32()), ("text", pa.int64()), ("chars", pa.int64())])


def _counted(held: dict[str, str] | None):
    """(host, digest, node, text, chars) of the nodes that pages share with their host's skeleton; no text is 0.

    Without ``held`` skeletons come before the pages, see :func:`_dealt`.
    """

    def run(batches):
        trees: dict[str, tuple[list, dict]] = {}
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for i, (host, digest, page) in enumerate(zip(*columns[:3], strict=True)):
                if host not in trees:
                    if held is None:
                        trees.clear()
                    trees[host] = (from_layout(columns[3][i] if held is None else held[host]), {})
                if page is not None:
                    tree, known = trees[host]
                    _, pairs = matching(folded(parse(page)), tree, known)
                    for p, t in pairs:
                        out.append((host, digest, t[2], text_name(p[3]), len(p[3])))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, _COUNT.types, strict=True)], schema=_COUNT)

    return run


def _dealt(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Rows of ``pages`` and of ``wrappers``, whose ``page`` is null: each host's wrapper stands before its pages.

    Pages of a hot host are dealt over parts, and each part has its copy of the wrapper.
    """
    hot = F.broadcast(common.hot_keys(pages, ["host"]))
    salts = F.coalesce("__salts", F.lit(1))
    own = pages.join(hot, "host", "left").withColumn("__salt", F.pmod(F.xxhash64("page_id", "url", "digest"), salts).cast("int"))
    other = wrappers.join(hot, "host", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    both = own.unionByName(other, allowMissingColumns=True)
    return both.repartition("host", "__salt").sortWithinPartitions("host", "__salt", F.col("page").isNotNull())


def _carried(df: DataFrame, column: str) -> bool:
    """Whether the texts of a written table are few enough to go with the tasks."""
    return (df.agg(F.sum(F.octet_length(column))).first()[0] or 0) <= CARRIED


def host_wrappers(base: DataFrame) -> DataFrame:
    """(host, skeleton, counts) from (page_id, url, host, digest, page), a written table; each distinct page counts once."""
    pages = base.where("page <> ''")
    found = pages.select("host", "digest", "page").mapInArrow(words.released(_layouts), "host string, digest long, layout string")
    times = found.groupBy("host", "layout", "digest").agg(F.lit(1).alias("n")).groupBy("host", "layout").agg(F.count("*").alias("n"))
    trees = _merged(common.table(times.select("host", "n", "layout"), "layouts"))
    schema = "host string, digest long, node int, text long, chars long"
    if _carried(trees, "skeleton"):
        held = {r.host: r.skeleton for r in trees.collect()}  # at most CARRIED bytes
        rows = pages.select("host", "digest", "page").mapInArrow(words.released(_counted(held)), schema)
    else:
        rows = _dealt(pages, trees).select("host", "digest", "page", "skeleton").mapInArrow(words.released(_counted(None)), schema)
    texts = rows.distinct().groupBy("host", "node", "text").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    best = F.max(F.when(F.col("text") != 0, F.struct("n", "text")))
    nodes = texts.groupBy("host", "node").agg(F.sum("n").alias("pages"), best.alias("best"), F.sum("chars").alias("chars"))
    line = F.format_string("%d %d %d %d %d", "node", "pages", F.coalesce("best.n", F.lit(0)), "chars", F.coalesce("best.text", F.lit(0)))
    counts = nodes.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("counts"))
    return common.table(trees.join(counts, "host"), "wrappers", 8)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _wrapper(text: str, counts: str) -> Wrapper:
    return Wrapper(text, [tuple(map(int, line.split())) for line in counts.split("\n")])


def _extracted(held: dict[str, tuple[str, str]] | None):
    """Rows of the result; without ``held`` wrappers come before the pages, see :func:`_dealt`."""

    def run(batches):
        known: dict[str, Wrapper] = {}
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for i, (number, url, host, page) in enumerate(zip(*columns[:4], strict=True)):
                if host not in known and (page is None if held is None else page):
                    if held is None:
                        known.clear()
                    known[host] = _wrapper(*((columns[4][i], columns[5][i]) if held is None else held[host]))
                if page is not None:
                    text = main_text(page, known[host]) if page else ""
                    out.append((number, url, text, len(text)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, _OUT.types, strict=True)], schema=_OUT)

    return run


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages``."""
    spark = pages.sparkSession
    common.arrow_rows(spark)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    page = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), page.alias("page"), F.xxhash64(page).alias("digest"))
    wrappers = host_wrappers(base)
    schema = "page_id long, url string, text string, n_chars long"
    if _carried(wrappers, "skeleton") and _carried(wrappers, "counts"):
        held = {r.host: (r.skeleton, r.counts) for r in wrappers.collect()}  # at most 2 x CARRIED bytes
        return base.select("page_id", "url", "host", "page").mapInArrow(words.released(_extracted(held)), schema)
    return _dealt(base, wrappers).select("page_id", "url", "host", "page", "skeleton", "counts").mapInArrow(words.released(_extracted(None)), schema)
