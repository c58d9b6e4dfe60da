"""MinHash near-dedup: odd sketches verify banded candidates before full sets confirm them.

A document's set holds its distinct word shingles as 64-bit hashes.  Each set gets PERMUTATIONS
MinHash values; ROWS of them make a band key, and all of them fold into an odd sketch (a parity
bitmap whose XOR population count estimates the symmetric difference of two sets).

The plan never lists the pairs of a group, and carries numbers only until texts are needed:

1. Equal sets (128-bit fingerprint) collapse to one node, so exact copies cost nothing later.
2. In each band bucket the member that shares most buckets is the hub; members are paired with
   hubs only, filtered by odd sketch, and confirmed on full sets.  The links join components.
3. A bucket of three or more that still holds several components may hide a link between members
   that are not hubs.  For these, the shingles that a set shares with any other set, and its
   measured overlap with the hub, bound every intersection exactly; only pairs of different
   components that pass these bounds and the sketch are confirmed.  This is complete for every
   pair that shares a band.  A hub's buckets are taken together and dealt over tasks by a salt.

Texts are read again only for the nodes of pairs and of buckets of three or more.
At similarity 0.8 a pair shares no band with probability (1 - 0.8^ROWS)^BANDS = 3e-6.

Defined results: a null or empty text has no shingle and links with nothing; fewer words than a
shingle make one shingle; a text of any length is one set, read whole; every row is judged by its
own text, so rows that share an id but not a text may get different components, and rows with equal
text (repeated ones too) get the same; a null id forms its own unlinked row (component null, kept);
among equally good hubs the one of the earliest row is taken, which changes no result; extra columns,
of whatever name, are ignored; an empty table gives no rows; ids may be of any type that has an order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, gram_hashes, heavy_join, map_batches, mix, text_keys, utf8

ROWS, BANDS = 5, 32
PERMUTATIONS = ROWS * BANDS
SKETCH_WORDS = 10
#: XOR bits over which a pair is given up: at similarity 0.8, 58 of 640 are expected, with a deviation of 9.
SKETCH_CUT = 104
#: Members of a hub's buckets, at most about, that meet the others of these in one task.
SALTED = 512

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 2**31, PERMUTATIONS, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 2**32, PERMUTATIONS, np.uint32)[:, None]
_SLOT = np.arange(PERMUTATIONS, dtype=np.uint64) << np.uint64(40)


def shingles(text: bytes, k: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word shingles (lower-cased A-Z)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(hashes.of(words), min(k, len(words))))


def minhash(s: np.ndarray) -> np.ndarray:
    x = (mix(s) >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(low, (_A * x[None, k : k + 1024] + _B).min(axis=1), out=low)
    return low


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def odd_sketch(signature: np.ndarray) -> np.ndarray:
    bit = mix(_SLOT | signature.astype(np.uint64)) % np.uint64(64 * SKETCH_WORDS)
    parity = np.bincount(bit.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc, k1, k2 (of the text), row (a number of its own), n (set size), f1, f2 (fingerprint of the set), bands, sketch.

    Bands and sketch are null where the task met an equal set before.
    """
    kinds = [("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))]
    kept = ["doc", "__k1", "__k2", "row"]

    def run(batches):
        hashes = WordHashes()
        met: set[bytes] = set()
        for b in batches:
            rows = []
            for t in utf8(b, "text"):
                s = shingles(t, k, hashes)
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                print_ = xxhash.xxh3_128_digest(s.tobytes())
                f1, f2 = np.frombuffer(print_, np.int64)
                sig = None if print_ in met else minhash(s)
                met.add(print_)
                rows.append((len(s), f1, f2, None, None) if sig is None else (len(s), f1, f2, band_keys(sig), odd_sketch(sig)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(list(c), t) for c, (_, t) in zip(cols, kinds, strict=True))], [*kept, *(x for x, _ in kinds)])

    keyed = keyed_texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(keyed, run, f"doc {kind}, __k1 long, __k2 long, row long, n long, f1 long, f2 long, bands array<long>, sketch array<long>")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, text and the two keys of the text."""
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), *text_keys(F.col(text_col)))


def overlaps(pairs: DataFrame, texts_a: DataFrame, texts_b: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with common, the size of their sets' intersection, and linked: 100 * common >= percent * union."""
    joined = pairs.join(texts_b.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts_a.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            common, linked = [], []
            last, y = None, None
            for b, t, u in zip(batch.column("b").to_pylist(), utf8(batch, "text_a"), utf8(batch, "text_b"), strict=True):
                x = shingles(t, k, hashes)
                if b != last:
                    last, y = b, shingles(u, k, hashes)
                common.append(len(np.intersect1d(x, y, assume_unique=True)))
                linked.append(100 * common[-1] >= percent * (len(x) + len(y) - common[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "common", "linked"])

    return map_batches(joined, run, "a long, b long, common long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for the nodes of links (a, b) but the roots; alternating large and small stars."""
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        edges = cut(small)
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        state = new


def sketch_close(a: str, b: str):
    """The odd sketches of the columns a and b are near enough for the full sets to be compared."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SKETCH_WORDS)), F.lit(0)) <= SKETCH_CUT


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, kept for each row of docs."""
    return judged(docs, k, percent, id_col, text_col).select(F.col("doc").alias(id_col), "n_shingles", "component_id", "kept")


def judged(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc, __k1, __k2, n_shingles, component_id, kept for each row of docs."""
    sig = cut(signatures(docs, k, id_col, text_col))
    usable = sig.where("n > 0 and doc is not null")
    sets_of = cut(usable.groupBy("f1", "f2").agg(F.min(F.when(F.col("bands").isNotNull(), F.col("row"))).alias("node"), F.min("doc").alias("first"), F.count("*").alias("copies")))
    root = linked_nodes(docs, usable, sets_of, k, percent, id_col, text_col)

    # The name of a component is its smallest id; a set that links with no other is its own component.
    placed = sets_of.join(root.union(root.select("root", "root").distinct()), "node")
    named = placed.groupBy("root").agg(F.min("first").alias("least"))
    component = sets_of.select("f1", "f2", "node", "first", "copies").join(placed.select("node", "root").join(named, "root").select("node", "least"), "node", "left").select("f1", "f2", "copies", F.coalesce("least", "first").alias("component"))
    rows = sig.select("doc", "__k1", "__k2", "n", "f1", "f2")
    alone = "n = 0 or doc is null"
    out = heavy_join(rows.where(f"not ({alone})"), cut(component), ["f1", "f2"], "copies").unionByName(rows.where(alone).withColumn("component", F.col("doc")))
    kept = F.coalesce(F.col("doc") == F.col("component"), F.lit(True))
    return out.select("doc", "__k1", "__k2", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def linked_nodes(docs: DataFrame, usable: DataFrame, sets_of: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """node, root for the sets that link with another, but the roots."""
    ratio = F.lit(percent)
    banded = usable.where("bands is not null").select(F.col("row").alias("node"), F.explode("bands").alias("key"))
    live = cut(banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    # Several tasks may have met a set: only its node stays.
    met = cut(banded.join(live, "key", "left_semi").join(sets_of.select("node"), "node", "left_semi"))
    member = cut(met.join(met.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key"))
    central = member.groupBy("node").agg(F.sum("c").alias("weight"))
    hub = cut(member.join(central, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("h"), F.count("*").alias("c")).select("key", (-F.col("h.minus")).alias("hub"), "c"))
    sketches = cut(usable.select(F.col("row").alias("node"), "doc", "__k1", "__k2", "n", "sketch").join(central.select("node"), "node", "left_semi"))
    to_hub = member.join(hub, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    side = lambda c: sketches.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    pairs = to_hub.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= ratio * F.greatest("na", "nb"))
    pairs = cut(pairs.where(sketch_close("sa", "sb")).select("a", "b"))

    # Buckets of three or more may hold links between members other than hubs, and need the sets of all their members.
    # Those of one hub are taken together, so that a pair meets once for each hub that it shares.
    crowd = cut(member.where("c > 2").join(hub.select("key", "hub"), "key").select("node", "hub").distinct())
    wanted = pairs.select(F.col("a").alias("node"), F.lit(False).alias("hub")).union(pairs.select("b", F.lit(True))).union(crowd.select("node", F.lit(False))).groupBy("node").agg(F.max("hub").alias("hub"))
    texts = cut(texts_of(docs, wanted.join(sketches.select("node", "doc", "__k1", "__k2"), "node"), id_col, text_col))
    measured = cut(overlaps(pairs, texts, texts.where("hub"), k, percent))
    links = measured.where("linked").select("a", "b")
    root = cut(components(links))

    placed = crowd.join(root, "node", "left").select("node", "hub", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("hub").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("hub", F.ceil(F.col("c") / SALTED).cast("int").alias("salts"))
    placed = cut(placed.join(mixed, "hub"))
    bounded = cut(shared_counts(texts, cut(placed.select("node").distinct().join(sketches.select("node", "n", "sketch"), "node")), k, percent))
    with_hub = measured.select(F.col("a").alias("node"), F.col("b").alias("hub"), "common")
    rest = placed.join(bounded, "node").where("node <> hub").join(with_hub, ["node", "hub"], "left")
    rest = cut(rest.join(root.select(F.col("node").alias("hub"), F.col("root").alias("head")), "hub", "left").withColumn("head", F.coalesce("head", "hub")))
    x = rest.where("root <> head").withColumn("salt", F.pmod(F.hash("node"), "salts")).alias("x")
    y = rest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
    # An intersection has no more than each side shares with any set; and, with the overlaps of both with their
    # hub known, no more than the smaller overlap and the smaller number of shared shingles beside the hub's.
    beside = lambda t: F.col(f"{t}.shared") - F.col(f"{t}.common")
    through = F.least(F.col("x.common"), F.col("y.common")) + F.least(beside("x"), beside("y"))
    most = F.least(F.col("x.shared"), F.col("y.shared"))
    most = F.when(F.col("x.common").isNotNull() & F.col("y.common").isNotNull(), F.least(most, through)).otherwise(most)
    together = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.root") != F.col("y.root"))
    able = ((100 + ratio) * most >= ratio * (F.col("x.n") + F.col("y.n"))) & (100 * F.least(F.col("x.n"), F.col("y.n")) >= ratio * F.greatest(F.col("x.n"), F.col("y.n")))
    more = cut(x.join(y, together & able & sketch_close("x.sketch", "y.sketch")).select(F.greatest(F.col("x.node"), F.col("y.node")).alias("a"), F.least(F.col("x.node"), F.col("y.node")).alias("b")).distinct())
    if more.isEmpty():
        return root
    return components(links.union(overlaps(more, texts, texts, k, percent).where("linked").select("a", "b")))


def texts_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, hub, text of the nodes (with the id and keys of their row)."""
    key = ["doc", "__k1", "__k2"]
    # Nodes grow with the corpus, so this is a shuffle join at every size: a small run then costs what a large one does.
    return keyed_texts(docs, id_col, text_col).join(nodes.hint("merge"), key).dropDuplicates(key).select("node", "hub", "text")


def shared_counts(texts: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The nodes (node, n, sketch) where a link is possible, with shared: how many shingles of its set stand in another set too.

    Partners of a node are members of the same buckets, so counting among such nodes bounds every intersection.
    """

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            for node, t in zip(b.column("node").to_pylist(), utf8(b, "text"), strict=True):
                grams = shingles(t, k, hashes).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), node, np.int64)), pa.array(grams)], ["node", "gram"])

    rows = map_batches(texts.select("node", "text").join(nodes.select("node"), "node", "left_semi"), run, "node long, gram long")
    # A gram with one owner isn't shared; the owners of the others aren't listed.
    owners = rows.groupBy("gram").agg(F.count("*").alias("c"), F.min("node").alias("node"))
    single = owners.where("c = 1").groupBy("node").agg(F.count("*").alias("own"))
    counted = nodes.join(single, "node", "left").select("node", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"), "n", "sketch")
    return counted.where(100 * F.col("shared") >= percent * F.col("n"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their component, with all their columns."""
    key = ["doc", "__k1", "__k2"]
    gone = cut(judged(docs, k, percent, id_col, text_col).where(~F.col("kept")).select(*key).distinct())
    whole = docs.select(F.struct("*").alias("whole"), F.col(id_col).alias("doc"), *text_keys(F.col(text_col)))
    return whole.join(gone, key, "left_anti").select("whole.*")
