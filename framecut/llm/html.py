"""HTML extraction by wrapper induction over pages of one host.

1. Each page becomes a DOM tree, and that a skeleton: its structural elements (tag and class) with
   the hash and length of their content and of what stands outside inner ones, runs of equal
   siblings merged.  Nothing but scripts, styles and the like is left out of it.  Pages of a host
   with equal skeletons count once.
2. A host's pages are dealt into blocks of about BLOCK; in a block every skeleton is aligned
   with the first by simple tree matching.  For each path the block tells how often it was aligned,
   how many characters in it vary, on how many pages it stands, and on how many with the same content.
   Blocks are summed by host and path, so all pages count and no host meets in one task.
3. Content that stands at a path on nearly all pages that have the path is template (menus, notices,
   footers of the host); other content at the path is not.  The wrapper of a host is the deepest
   container that holds all of the varying text, but an article or main that holds most of it is
   taken whole.  Pages take the text of the wrapper's container without template; a page without
   it, and a host without a wrapper (fewer than MIN_ALIGNED aligned pages), use article, main or body.

Advertisements, menus and comments may vary from page to page: elements whose tag or class names
such a part don't count as varying text and are left out; a class or id counts if it names
such a part, with no words beside but neutral ones (list, box, slot).  What wraps the main text is never left out (spare).

Defined results: null or empty html gives an empty text; broken markup is closed like browsers do;
pages of any length and nesting are read whole (no step recurses); a null url is a host of its own;
repeated rows give repeated results; of equally deep containers the one with more varying text is
the wrapper, then the one of larger path; an empty table gives no rows; extra columns stay.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import lru_cache
from html import unescape
from itertools import groupby
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches

BLOCK = 8
#: Share of the text that makes a container the main one; share of equal texts that makes a template; pages needed.
MAIN_SHARE, CONSTANT, MIN_ALIGNED = 0.8, 0.9, 4
#: A template of more than this share of a page's main text is kept: the page would be a copy of others, not boilerplate.
MOST = 0.5

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACE = re.compile(r"\s+")
RAW = frozenset("script style textarea title noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CONTAINER = frozenset("html body main article section div td center".split())
#: Elements of no skeleton; elements whose whole text counts as their parent's own.
SKIPPED = frozenset("head script style title noscript template iframe svg object select textarea button".split())
LEAVES = INLINE | VOID | frozenset("p h1 h2 h3 h4 h5 h6 pre li dt dd option summary figcaption caption address".split())
#: Child lists whose product is larger are matched by rows of numpy instead of lists; the matching is the same.
CELLS = 1024
#: A start tag closes these open elements; the search stops at the scope's elements.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body article section main div table ul ol dl td th nav aside header footer form blockquote button".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NOISE_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea menu dialog object".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner menu nav navbar navigation sidebar footer notice cookie cookies consent comment comments related share sharing social breadcrumb breadcrumbs newsletter popup modal disclaimer copyright pagination masthead subscribe".split())
#: Words that say nothing of what a part holds, beside a noise word (comment-list, ad-slot, related-posts).
NEUTRAL_WORDS = frozenset("list item items box slot unit block area section container wrap wrapper inner outer top bottom left right site page widget thread bar posts post links link group row col panel module zone holder label title header form button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "names", "kids", "spared")

    def __init__(self, tag: str, names: str) -> None:
        self.tag, self.names, self.kids, self.spared = tag, names, [], False

    def key(self) -> str:
        return f"{self.tag}.{self.names}" if self.names else self.tag


def parse(html: str) -> Node:
    """DOM tree of a page; texts are kept as strings with references decoded."""
    root = Node("#", "")
    stack, at, n = [root], 0, len(html)
    opened: Counter = Counter()

    def close(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    while at < n:
        m = MARKUP.search(html, at)
        start = m.start() if m else n
        if start > at:
            stack[-1].kids.append(unescape(html[at:start]))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k].tag in SCOPE:
                    break
            continue
        ends = CLOSES.get(tag, ())
        if tag in CLOSES_P:
            ends = ("p",)
        if any(opened[x] for x in ends):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    close(k)
                    break
                if stack[k].tag in SCOPE and stack[k].tag not in ("table", "dl"):
                    break
        names = " ".join(sorted({w for a in ATTRIBUTE.finditer(m[3]) if (w := (a[2] or a[3] or a[4] or "").lower().strip())})) if m[3] else ""
        node = Node(tag, names)
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*>", re.I).search(html, at)
            stop = end.start() if end else n
            node.kids.append(html[at:stop])
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] += 1
    spare(root)
    return root


def spare(root: Node) -> None:
    """Marks the elements that are no noise whatever their names.

    These wrap a main, are forms around an article, or wrap the longest article where all stand in noise;
    on a page without article and main, they hold MAIN_SHARE of the text outside navigation and the like.
    """
    nodes, above, clear = [root], [-1], [True]
    for at, x in enumerate(nodes):
        for k in x.kids:
            if isinstance(k, Node):
                nodes.append(k)
                above.append(at)
                clear.append(clear[at] and not is_noise(k, False))
    found = [i for i, x in enumerate(nodes) if x.tag in ("article", "main")]
    size = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        size[i] += sum(len(k.strip()) for k in nodes[i].kids if isinstance(k, str))
        if i and (nodes[i].tag == "form" or nodes[i].tag not in NOISE_TAGS):
            size[above[i]] += size[i]
    if not found:
        for i, x in enumerate(nodes):
            x.spared = (x.tag == "form" or x.tag not in NOISE_TAGS) and 0 < MAIN_SHARE * size[0] <= size[i]
        return
    longest = -1 if any(clear[i] for i in found) else max(found, key=size.__getitem__)
    for i in found:
        whole, k = nodes[i].tag == "main" or i == longest, i
        while k >= 0:
            if whole or nodes[k].tag == "form":
                nodes[k].spared = True
            k = above[k]


def is_noise(node: Node, inside: bool) -> bool:
    """Whether a node is no content; inside: within the main container, where a header may hold the title."""
    if node.spared:
        return False
    if node.tag in NOISE_TAGS or node.tag == "header" and not inside:
        return True
    return bool(node.names) and node.tag not in HEADINGS and any(names_noise(w) for w in node.names.split())


@lru_cache(100_000)
def names_noise(token: str) -> bool:
    """Whether a class, id or role has a noise word and no word of its own beside (comment-list is noise, related-work isn't)."""
    words = [w for w in re.split(r"[^a-z]+", token) if w]
    return any(w in NOISE_WORDS for w in words) and all(w in NOISE_WORDS or w in NEUTRAL_WORDS for w in words)


def raw_text(node: Node) -> str:
    """All text below an element but that of scripts and the like."""
    parts: list[str] = []
    stack = node.kids[::-1]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag not in SKIPPED:
            stack.extend(reversed(x.kids))
    return " ".join(parts)


def path_of(parent: int, key: str) -> int:
    """Number of the path that leads over a key on from a parent's path."""
    return xxhash.xxh64_intdigest(key, parent & 0xFFFFFFFFFFFFFFFF) - 2**63


class Slot:
    """A run of neighbours with equal keys in a skeleton: parent (place in the list), path, depth, own text, all content."""

    __slots__ = ("parent", "key", "path", "depth", "noise", "own", "own_size", "hash", "size", "run")

    def __init__(self, parent: int, key: str, path: int, depth: int, noise: bool, own: int, own_size: int, run: list[Node]) -> None:
        self.parent, self.key, self.path, self.depth, self.noise, self.run = parent, key, path, depth, noise, run
        self.own = self.hash = own
        self.own_size = self.size = own_size


def skeleton(root: Node) -> list[Slot]:
    """The slots of a page, parents before children; sizes are without noise, hashes of everything."""
    out: list[Slot] = []
    stack: list[tuple[int, list[Node]]] = [(-1, [root])]
    while stack:
        parent, run = stack.pop()
        texts: list[str] = []
        inner: list[Node] = []
        for x in run:
            for k in x.kids:
                if isinstance(k, str):
                    texts.append(k)
                elif k.tag in LEAVES:
                    texts.append(raw_text(k))
                elif k.tag not in SKIPPED:
                    inner.append(k)
        own = SPACE.sub(" ", " ".join(texts)).strip()
        key, above = run[0].key(), out[parent] if out else None
        at = len(out)
        out.append(Slot(parent, key, path_of(above.path, key) if above else 0, above.depth + 1 if above else 0, is_noise(run[0], False), xxhash.xxh32_intdigest(own) if own else 0, len(own), run))
        stack.extend((at, list(r)) for r in reversed([list(g) for _, g in groupby(inner, Node.key)]))
    for x in reversed(out[1:]):
        above = out[x.parent]
        above.hash = (above.hash * 1_000_003 + x.hash + xxhash.xxh32_intdigest(x.key)) & 0xFFFFFFFF
        if not x.noise:
            above.size += x.size
    return out


def children(tree: list) -> list[list[int]]:
    kids: list[list[int]] = [[] for _ in tree]
    for i, x in enumerate(tree):
        if x.parent >= 0:
            kids[x.parent].append(i)
    return kids


def next_row(row, weights):
    """The best matchings with one more child on the left, by how many there are on the right."""
    if isinstance(row, list):
        out = [0]
        for j, w in enumerate(weights):
            out.append(max(row[j + 1], out[-1], row[j] + w))
        return out
    return np.concatenate((row[:1], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights))))


class Rows:
    """The table of two child lists' matching, row by row; every step-th is kept, others are worked out again."""

    def __init__(self, x: tuple[int, ...], y: tuple[int, ...], keys: list[str], score: dict[tuple[int, int], int]) -> None:
        self.x, self.y, self.keys, self.score = x, y, keys, score
        self.wide = len(x) * len(y) > CELLS
        of: dict[int, int] = {}
        self.which = [of.setdefault(v, len(of)) for v in y]
        self.places: dict[str, list[int]] = {}
        for v in of:
            self.places.setdefault(keys[v], []).append(v)
        self.of, self.found = of, {}
        if self.wide:
            self.which = np.array(self.which)

    def weights(self, u: int):
        found = self.found.get(u)
        if found is None:
            found = [0] * len(self.of)
            for v in self.places.get(self.keys[u], ()):
                found[self.of[v]] = self.score[u, v]
            self.found[u] = found = np.array(found, np.int64) if self.wide else found
        return found[self.which] if self.wide else [found[k] for k in self.which]

    def first(self):
        return np.zeros(len(self.y) + 1, np.int64) if self.wide else [0] * (len(self.y) + 1)

    def best(self) -> int:
        row = self.first()
        for u in self.x:
            row = next_row(row, self.weights(u))
        return int(row[-1])

    def pairs(self) -> list[tuple[int, int]]:
        """Places in both lists of the children matched."""
        step, row = isqrt(len(self.x)) + 1, self.first()
        kept = []
        for i, u in enumerate(self.x):
            if i % step == 0:
                kept.append(row)
            row = next_row(row, self.weights(u))
        i, j, out = len(self.x), len(self.y), []
        while i and j:
            base = (i - 1) // step * step
            rows = [kept[base // step]]
            for u in self.x[base:i]:
                rows.append(next_row(rows[-1], self.weights(u)))
            while i > base and j:
                now, above = rows[i - base], rows[i - base - 1]
                if now[j] == above[j]:
                    i -= 1
                elif now[j] == now[j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((i, j))
        return out[::-1]


def tree_match(a: list, b: list) -> list[tuple[int, int]]:
    """Simple tree matching of two skeletons: the matched places, parents first.

    Subtrees that are alike in all keys are one shape.  Two shapes are matched once, however often they meet, and
    a shape with itself is matched whole.
    """
    below_a, below_b = children(a), children(b)
    known: dict[tuple[str, tuple[int, ...]], int] = {}
    keys: list[str] = []
    forms: list[tuple[int, ...]] = []
    sizes: list[int] = []

    def shapes(tree: list, below: list[list[int]]) -> list[int]:
        out = [0] * len(tree)
        for i in range(len(tree) - 1, -1, -1):
            form = tuple([out[k] for k in below[i]])
            out[i] = known.setdefault((tree[i].key, form), len(forms))
            if out[i] == len(forms):
                keys.append(tree[i].key)
                forms.append(form)
                sizes.append(1 + sum(sizes[k] for k in form))
        return out

    of_a, of_b = shapes(a, below_a), shapes(b, below_b)
    met = {(of_a[0], of_b[0])} if a and b and a[0].key == b[0].key else set()
    open_ = list(met)
    while open_:
        p, q = open_.pop()
        if p == q:
            continue
        places: dict[str, list[int]] = {}
        for v in dict.fromkeys(forms[q]):
            places.setdefault(keys[v], []).append(v)
        for u in dict.fromkeys(forms[p]):
            for v in places.get(keys[u], ()):
                if (u, v) not in met:
                    met.add((u, v))
                    open_.append((u, v))
    score: dict[tuple[int, int], int] = {}
    for p, q in sorted(met, key=lambda z: sizes[z[0]]):  # children before parents
        score[p, q] = sizes[p] if p == q else 1 + Rows(forms[p], forms[q], keys, score).best() if forms[p] and forms[q] else 1
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    out = [(0, 0)] if met else []
    for p, q in out:  # grows while it is read
        u, v = of_a[p], of_b[q]
        if u == v:
            out.extend(zip(below_a[p], below_b[q], strict=True))
        elif forms[u] and forms[v]:
            if (u, v) not in chosen:
                chosen[u, v] = Rows(forms[u], forms[v], keys, score).pairs()
            out.extend((below_a[p][i], below_b[q][j]) for i, j in chosen[u, v])
    return out


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """(place in a, varying characters) of the slots that tree matching aligns; a child that only one side has varies."""
    pairs = tree_match(a, b)
    varies: dict[int, int] = {}
    free_a, free_b = [0] * len(a), [0] * len(b)  # characters of children, less those of matched ones
    for tree, free in ((a, free_a), (b, free_b)):
        for x in tree[1:]:
            if not x.noise:
                free[x.parent] += x.size
    for p, q in pairs[1:]:
        free_a[a[p].parent] -= 0 if a[p].noise else a[p].size
        free_b[b[q].parent] -= 0 if b[q].noise else b[q].size
    for p, q in reversed(pairs):
        own = 0 if (a[p].own, a[p].own_size) == (b[q].own, b[q].own_size) else max(a[p].own_size, b[q].own_size)
        varies[p] = varies.get(p, 0) + own + free_a[p] + free_b[q]
        if p and not a[p].noise:
            varies[a[p].parent] = varies.get(a[p].parent, 0) + varies[p]
    return [(p, varies[p]) for p, _ in pairs]


def outermost(root: Node, tag: str) -> list[Node]:
    out: list[Node] = []
    stack = root.kids[::-1]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            continue
        if x.tag == tag:
            out.append(x)
        elif not is_noise(x, False):
            stack.extend(reversed(x.kids))
    return out


def below(tree: list[Slot], tops: set[int]) -> list[bool]:
    """Whether each slot stands at or below one of the places tops."""
    out: list[bool] = []
    for i, x in enumerate(tree):
        out.append(i in tops or x.parent >= 0 and out[x.parent])
    return out


def main_text(root: Node, path: int | None = None, template: list[dict] = (), core: int | None = None) -> str:
    """Blocks of the main container, one a line; what leads to core, the host's place of most varying text, is no noise."""
    main: list[Node] = []
    constant: set[int] = set()
    if path is not None:
        tree = skeleton(root)
        for i, x in enumerate(tree):
            while x.path == core and i > 0:
                for node in tree[i].run:
                    node.spared = True
                i = tree[i].parent
        places = [i for i, x in enumerate(tree) if x.path == path]
        main = [node for i in places for node in tree[i].run]
        fixed = {(t["path"], t["text"]) for t in template}
        found = [i for i, inside in enumerate(below(tree, set(places))) if (inside or not main) and (tree[i].path, tree[i].size << 32 | tree[i].hash) in fixed]
        size = sum(tree[i].size for i in places) if main else tree[0].size
        outer = below(tree, set(found))
        found = [i for i in found if tree[i].parent < 0 or not outer[tree[i].parent]]
        if sum(tree[i].size for i in found) <= MOST * size:
            constant = {id(node) for i in found for node in tree[i].run}
    main = main or outermost(root, "article") or outermost(root, "main") or outermost(root, "body") or [root]
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if text := SPACE.sub(" ", "".join(now)).strip():
            blocks.append(text)
        now.clear()

    stack = [("in", x) for x in reversed(main)]
    inside = {id(x) for x in main}
    while stack:
        what, x = stack.pop()
        if what == "end":
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif id(x) in constant or id(x) not in inside and is_noise(x, True):
            continue
        elif x.tag in ("br", "wbr"):
            now.append(" " if x.tag == "br" else "")
        else:
            if x.tag not in INLINE:
                flush()
                stack.append(("end", x))
            stack.extend(("in", k) for k in reversed(x.kids))
    flush()
    return "\n".join(blocks)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", block: int = BLOCK) -> DataFrame:
    """host, root (path of the main container), core (of the deepest one with most varying text) and template (path, text) of the hosts that have one."""
    fields = Slot.__slots__[:-1]

    def shrink(batches):
        for b in batches:
            found = [json.dumps([[getattr(x, f) for f in fields] for x in skeleton(parse(h or ""))], separators=(",", ":")) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("order"), pa.array(found, pa.string())], ["host", "order", "tree"])

    def slots_of(tree: str) -> list[Slot]:
        out = []
        for parent, key, path, depth, noise, own, own_size, whole, size in json.loads(tree):
            x = Slot(parent, key, path, depth, noise, own, own_size, [])
            x.hash, x.size = whole, size
            out.append(x)
        return out

    trees = map_batches(pages.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(url_col, html_col).alias("order"), F.col(html_col).alias("html")), shrink, "host string, order long, tree string")
    trees = cut(trees.groupBy("host", "tree").agg(F.min("order").alias("order")))
    many = cut(trees.groupBy("host").agg(F.ceil(F.count("*") / block).alias("blocks")))  # of known size: Spark broadcasts it if small
    dealt = trees.join(many, "host").withColumn("bucket", F.pmod(F.xxhash64(F.lit(5), "order"), "blocks"))
    sums_of = ("aligned", "varies", "pages")

    def align(key, table):
        slots: dict[int, list] = {}  # by path: depth, container, article or main above, pages aligned, varying characters, pages that have it
        texts: Counter = Counter()
        rows = sorted(zip(table.column("order").to_pylist(), table.column("tree").to_pylist(), strict=True))
        pages = [slots_of(tree) for _, tree in rows]
        for tree in pages:
            over: list[tuple[int | None, int | None]] = []
            for x in tree:
                article, whole = over[x.parent] if x.parent >= 0 else (None, None)
                tag = x.key.split(".")[0]
                over.append((x.path if article is None and tag == "article" else article, x.path if whole is None and tag == "main" else whole))
                if x.path not in slots:
                    slots[x.path] = [x.depth, not x.noise and tag in CONTAINER, over[-1][1] if over[-1][0] is None else over[-1][0], 0, 0, 0]
            for path in {x.path for x in tree}:
                slots[path][5] += 1
            texts.update({(x.path, x.size << 32 | x.hash) for x in tree if x.depth > 2 and x.size})
        for tree in pages[1:]:
            for p, varies in aligned(pages[0], tree):
                cell = slots[pages[0][p].path]
                cell[3] += 1
                cell[4] += varies
        out = [(path, None, *cell) for path, cell in slots.items()]
        # A text of a template stands on most pages of nearly every block.
        out += [(path, t, 0, False, None, 0, 0, n) for (path, t), n in texts.items() if 2 * n >= slots[path][5]]
        columns = list(zip(*out)) or [()] * 8
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), *[pa.int64()] * 3)
        return pa.table({"host": pa.array([key[0].as_py()] * len(out), pa.string()), **{n: pa.array(v, t) for n, v, t in zip(("path", "text", "depth", "container", "above", *sums_of), columns, kinds, strict=True)}})

    # Dealt by both columns, or a join's partitioning by host would hold all blocks of a host in one task.
    sums = dealt.select("host", "bucket", "order", "tree").repartition("host", "bucket").groupBy("host", "bucket").applyInArrow(align, "host string, path long, text long, depth long, container boolean, above long, aligned long, varies long, pages long")
    sums = cut(sums.groupBy("host", "path", "text").agg(F.max("depth").alias("depth"), F.max("container").alias("container"), F.max("above").alias("above"), *(F.sum(c).alias(c) for c in sums_of)))
    slots = sums.where("text is null")
    whole = slots.where("depth = 0").select("host", F.col("varies").alias("whole"))
    place = F.struct("depth", "varies", "path", "above")
    rooted = slots.where(F.col("container") & (F.col("aligned") >= MIN_ALIGNED) & (F.col("varies") > 0)).join(whole, "host").where(F.col("varies") >= MAIN_SHARE * F.col("whole"))
    chosen = rooted.groupBy("host").agg(F.max(place).alias("core"), F.max(F.when(F.col("varies") >= F.col("whole"), place))["path"].alias("holds"))
    # The core's outermost article, or main, as of a page without wrapper.
    chosen = chosen.select("host", F.col("core.path").alias("core"), F.coalesce("core.above", "holds").alias("root"))
    same = sums.where("text is not null").select("host", "path", "text", F.col("pages").alias("same")).join(slots.select("host", "path", "pages"), ["host", "path"])
    fixed = same.where((F.col("pages") > MIN_ALIGNED) & (F.col("same") >= CONSTANT * F.col("pages")))
    return chosen.join(fixed.groupBy("host").agg(F.sort_array(F.collect_set(F.struct("path", "text"))).alias("template")), "host", "left")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The columns of pages but html_col, with text: the main text of each page (column text is replaced)."""
    # A written table's size is known, so Spark broadcasts it while it is small; beyond that AQE splits a hot host's join.
    rules = cut(wrappers(pages, url_col, html_col))
    kept = [c for c in pages.columns if c not in (html_col, "text")]
    row = F.struct(*kept) if kept else F.struct(F.lit(None).alias("none"))
    joined = pages.select(row.alias("row"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host")).join(rules, "host", "left").select("row", "html", "root", "template", "core")
    schema = joined.select("row", F.lit("").alias("text")).schema

    def run(batches):
        for b in batches:
            texts = [main_text(parse(h or ""), root, template or [], core) for h, root, template, core in zip(*(b.column(c).to_pylist() for c in ("html", "root", "template", "core")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    return map_batches(joined, run, schema).select(*(F.col("row").getField(c).alias(c) for c in kept), "text")
