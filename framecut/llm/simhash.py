"""SimHash near-dedup: fingerprints of 64 bits linked by a self-join of binary tries.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it.  Equal fingerprints collapse to
one node first, so exact copies cost nothing later.  Links, at most `budget` differing bits, are found by traversing
pairs of trie nodes together: a pair of nodes carries the bits in which their prefixes differ, leads to the pairs of
their children, and is given up when the bits exceed the budget.

How this is dealt over tasks: the bits are cut into blocks, some budget + 1 or more, and every choice of blocks minus
budget of them gives a trie with these blocks' bits on top.  Two fingerprints within the budget agree in whole on the top
of one of these tries at least, so below that depth the subtries can be joined each with itself, in separate tasks: a
subtrie is a bucket.  More fingerprints take more blocks (`blocks_for`), so buckets stay small on the whole.

A bucket above LARGE is not held by one task.  Its most copied fingerprint is its hub: members that the budget
links with it form one component.  Then Spark traverses the bucket's trie by node pairs, BITS bits a step, with counts and
components a node: pairs of one component only are given up too, the others go to tasks as soon as both nodes are small.
So a dense group costs in proportion to its size, and no group is collected whole.

Defined results: a null or empty text and one without words have fingerprint zero and link like any other; fewer words than
a shingle make one shingle; a text of any length is read whole; rows are judged each by its own text; repeated rows and
equal fingerprints share a component; a component's name is its smallest id, null ids aside (null where it has no other);
an empty table gives no rows; extra columns, of whatever name, are ignored; ids may be of any type that has an order.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, heavy_join, map_batches, utf8
from .neardup import components

BUDGET, SEED, WIDTH = 4, 42, 64
#: Fingerprints that one bucket is meant to have on average, at most, and those that one task traverses together.
USUAL, LARGE = 256, 2048
#: Bits that Spark descends in a step in the buckets above LARGE.
BITS = 8


def fingerprint(text: bytes, k: int) -> int:
    """Majority bits of the XXH64 hashes of the k-word shingles, repeats included, of a text with A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - k + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist(), strict=True)), np.uint64, n)
    octets = hashes.view(np.uint8).reshape(n, 8)
    if n < 64:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:  # each octet's histogram, then the bits of its 256 values
        counts = np.concatenate([np.bincount(octets[:, j], minlength=256) @ OCTET_BITS for j in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


OCTET_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc, print (64 bits as a long) of every row."""

    def run(batches):
        for b in batches:
            found = np.array([fingerprint(t, k) for t in utf8(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(found)], ["doc", "print"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), run, f"doc {kind}, print long")


class Orders:
    """The tries: each puts `blocks - budget` of the blocks of bits on top."""

    def __init__(self, blocks: int, budget: int):
        self.cuts = [round(WIDTH * k / blocks) for k in range(blocks + 1)]
        self.tops = list(itertools.combinations(range(blocks), blocks - budget))
        self.budget = budget

    def bits(self, top: tuple) -> int:
        return sum(self.cuts[b + 1] - self.cuts[b] for b in top)

    def arranged(self, prints, trie: int, shift, mask, join):
        """prints with the bits of the trie's blocks first; the three functions work on columns or on arrays alike."""
        top = self.tops[trie]
        out = None
        for b in [*top, *(b for b in range(len(self.cuts) - 1) if b not in top)]:
            size = self.cuts[b + 1] - self.cuts[b]
            piece = mask(shift(prints, -self.cuts[b]), size)
            out = piece if out is None else join(shift(out, size), piece)
        return out


def on_columns(orders: Orders, trie: int):
    shift = lambda c, n: F.shiftleft(c, n) if n > 0 else F.shiftrightunsigned(c, -n)
    return orders.arranged(F.col("print"), trie, shift, lambda c, n: c.bitwiseAND(F.lit((1 << n) - 1)) if n < WIDTH else c, lambda a, b: a.bitwiseOR(b))


def blocks_for(n: int, budget: int) -> int:
    """The fewest blocks whose exactly matched bits make buckets of USUAL fingerprints or fewer, were n spread evenly."""
    blocks = budget + 1
    while n > USUAL * 2.0 ** (WIDTH * (blocks - budget) / blocks) and WIDTH * (blocks - budget) / blocks < WIDTH / 2:
        blocks += 1
    return blocks


def close_pairs(values: np.ndarray, begin: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of values (uint64, ascending within each bucket; buckets begin at begin) of one bucket within the budget.

    All buckets' tries are traversed together, a level of bits at a time.  A node is a range of places.
    """
    sizes = np.diff(np.append(begin, len(values)))
    begin, sizes = begin[sizes > 1], sizes[sizes > 1]
    return traverse(values, begin, begin + sizes, begin, begin + sizes, np.zeros(len(begin), np.int64), budget)


def traverse(values, a, a_end, b, b_end, differ, budget) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the budget, of node pairs (range a to a_end with b to b_end; equal ranges: a node with itself)."""
    found = []
    for level in range(WIDTH - 1, -1, -1):
        if not len(a):
            break
        # Nodes of one fingerprint each: the rest of both paths is compared at once.
        single = (a_end - a == 1) & (b_end - b == 1)
        if single.any():
            i, j = a[single], b[single]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            found.append((i[near], j[near]))
            a, a_end, b, b_end, differ = (x[~single] for x in (a, a_end, b, b_end, differ))
        zeros = np.concatenate([[0], np.cumsum((values >> np.uint64(level)) & np.uint64(1) == 0)])
        a_mid, b_mid = a + zeros[a_end] - zeros[a], b + zeros[b_end] - zeros[b]
        itself = a == b
        kids = [(a, a_mid, b, b_mid, differ, None), (a_mid, a_end, b_mid, b_end, differ, None), (a, a_mid, b_mid, b_end, differ + 1, None), (a_mid, a_end, b, b_mid, differ + 1, ~itself)]
        kept = []
        for lo, hi, lo2, hi2, d, only in kids:
            keep = (hi > lo) & (hi2 > lo2) & (d <= budget) & ~((lo == lo2) & (hi - lo == 1))
            keep = keep if only is None else keep & only
            kept.append([x[keep] for x in (lo, hi, lo2, hi2, d)])
        a, a_end, b, b_end, differ = (np.concatenate(x) for x in zip(*kept, strict=True))
    for lo, hi, lo2, hi2 in zip(a, a_end, b, b_end, strict=True):  # equal values in both nodes, each place with each
        i, j = np.meshgrid(np.arange(lo, hi), np.arange(lo2, hi2), indexing="ij")
        found.append((i.ravel(), j.ravel()))
    empty = np.empty(0, np.int64)
    return (np.concatenate([empty, *(i for i, _ in found)]), np.concatenate([empty, *(j for _, j in found)]))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that links lead to, of each of n places."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def bucket_links(rows: DataFrame, orders: Orders) -> DataFrame:
    """a, b: links that join each component of each bucket, for (trie, key, print) rows; a bucket is in one task."""

    def linked(trie, key, prints):
        values = np.empty(len(prints), np.uint64)
        for t in np.unique(trie):
            mine = trie == t
            full = lambda n: np.uint64((1 << n) - 1)
            values[mine] = orders.arranged(prints[mine], int(t), lambda x, n: x << np.uint64(n) if n > 0 else x >> np.uint64(-n), lambda x, n: x & full(n), lambda x, y: x | y)
        order = np.lexsort((values, key, trie))
        trie, key, values, prints = trie[order], key[order], values[order], prints[order]
        begin = np.flatnonzero(np.concatenate([[True], (trie[1:] != trie[:-1]) | (key[1:] != key[:-1])]))
        i, j = close_pairs(values, begin, orders.budget)
        root = forest(i, j, len(values))
        child = np.flatnonzero(root != np.arange(len(root)))
        a, b = prints.view(np.int64)[child], prints.view(np.int64)[root[child]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    def run(batches):
        held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64)]
        for batch in batches:
            new = [batch.column("trie").to_numpy(), batch.column("key").to_numpy(), batch.column("print").to_numpy().view(np.uint64)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if len(held[0]) < LARGE:
                continue
            # All but the last bucket, which the next batch may go on with.
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            end = last[-1] + 1 if len(last) else 0
            if end:
                yield linked(*(x[:end] for x in held))
                held = [x[end:] for x in held]
        if len(held[0]):
            yield linked(*held)

    return map_batches(rows.select("trie", "key", "print").repartition("trie", "key").sortWithinPartitions("trie", "key"), run, "a long, b long")


def large_links(rows: DataFrame, sizes: DataFrame, orders: Orders, large: int) -> DataFrame:
    """a, b: links that join the components of the buckets above large, for (trie, key, copies, print) rows of these."""
    bucket = ["trie", "key"]
    hubs = cut(rows.groupBy(*bucket).agg(F.max(F.struct("copies", "print")).alias("h"), F.count("*").alias("c")).select(*bucket, F.col("h.print").alias("hub"), "c"))
    at_hub = heavy_join(rows, hubs, bucket, "c").where((F.col("print") != F.col("hub")) & (F.bit_count(F.col("print").bitwiseXOR(F.col("hub"))) <= orders.budget))
    links = cut(at_hub.select(F.greatest("print", "hub").alias("a"), F.least("print", "hub").alias("b")).distinct())
    root = cut(components(links))
    arranged = F.coalesce(*(F.when(F.col("trie") == t, on_columns(orders, t)) for t in range(len(orders.tops))))
    rows = cut(rows.join(root.withColumnRenamed("node", "print"), "print", "left").select(*bucket, "print", F.coalesce("root", "print").alias("root"), arranged.alias("value")))
    prefix = lambda depth: F.shiftrightunsigned("value", WIDTH - depth) if depth < WIDTH else F.col("value")
    # The top bits are those of the bucket.
    depth, small = min(map(orders.bits, orders.tops)), []
    top = F.coalesce(*(F.when(F.col("trie") == t, F.shiftrightunsigned("key", orders.bits(bits) - depth)) for t, bits in enumerate(orders.tops)))
    pairs = cut(sizes.select(*bucket, top.alias("a"), top.alias("b"), F.lit(0).alias("differ")))
    while depth < WIDTH:
        step = min(BITS, WIDTH - depth)
        depth += step
        node = rows.groupBy(*bucket, prefix(depth).alias("node")).agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        node = cut(node.withColumn("up", F.shiftrightunsigned("node", step)))
        side = lambda s: node.select(*bucket, F.col("up").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "lo", "hi")))  # noqa: E731, B023
        kids = pairs.join(side("a"), [*bucket, "a"]).join(side("b"), [*bucket, "b"])
        kids = kids.withColumn("differ", F.col("differ") + F.bit_count(F.col("node_a").bitwiseXOR(F.col("node_b")).bitwiseAND(F.lit((1 << step) - 1))))
        ordered = (F.col("a") != F.col("b")) | (F.col("node_a") <= F.col("node_b"))
        several = F.least("lo_a", "lo_b") != F.greatest("hi_a", "hi_b")
        kids = cut(kids.where(ordered & several & (F.col("differ") <= orders.budget)).select(*bucket, F.col("node_a").alias("a"), F.col("node_b").alias("b"), "differ", (F.col("n_a") + F.col("n_b")).alias("n")))
        done = F.col("n") <= large if depth < WIDTH else F.lit(True)
        small.append((depth, kids.where(done)))
        pairs = kids.where(~done).drop("n")
        if pairs.isEmpty():
            break
    for at, ready in small:
        # Both nodes' fingerprints, as one bucket named by the pair; pairs of one node with itself have it once.
        named = ready.select(*bucket, "a", "b", F.xxhash64("key", "a", "b").alias("pair"))
        ends = named.select(*bucket, "pair", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
        members = ends.join(rows.withColumn("node", prefix(at)), [*bucket, "node"]).select("trie", F.col("pair").alias("key"), "print")
        links = links.union(bucket_links(members, orders))
    return links


def linked_prints(nodes: DataFrame, budget: int, large: int, blocks: int | None) -> DataFrame:
    """node, root of the fingerprints that link with another, but the roots, for (print, copies)."""
    orders = Orders(blocks or blocks_for(nodes.count(), budget), budget)
    tries = F.array(*(F.struct(F.lit(t).alias("trie"), F.shiftrightunsigned(on_columns(orders, t), WIDTH - orders.bits(top)).alias("key")) for t, top in enumerate(orders.tops)))
    rows = nodes.select("print", "copies", F.explode(tries).alias("x")).select("x.*", "print", "copies")
    sizes = cut(rows.groupBy("trie", "key").agg(F.count("*").alias("c")).where("c > 1"))
    hot = sizes.where(F.col("c") > large)
    if hot.isEmpty():
        return components(bucket_links(rows.join(sizes.drop("c"), ["trie", "key"], "left_semi"), orders))
    usual = rows.join(sizes.where(F.col("c") <= large).drop("c"), ["trie", "key"], "left_semi")
    flagged = cut(heavy_join(rows, cut(hot.withColumn("large", F.lit(True))), ["trie", "key"], "c").where("large").drop("large"))
    return components(bucket_links(usual, orders).union(large_links(flagged, hot.drop("c"), orders, large)))


def near_duplicates(docs: DataFrame, k: int = 5, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE, blocks: int | None = None) -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id for each row of docs; large and blocks change no result."""
    rows = cut(fingerprints(docs, k, id_col, text_col))
    nodes = cut(rows.groupBy("print").agg(F.min("doc").alias("first"), F.count("*").alias("copies")))
    root = cut(linked_prints(nodes, budget, large, blocks))
    placed = nodes.join(root.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("c"))
    component = cut(heavy_join(placed, cut(named), ["root"], "c").select("print", "component_id", "copies"))
    out = heavy_join(rows, component, ["print"], "copies")
    return out.select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
