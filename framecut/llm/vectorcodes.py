"""Vector code compression: vectors as one byte a part, by codebooks learnt in integers.

Components become integers floor(scale * x) and vectors are cut into equal parts.  Each part position has a
codebook, refined by rounds of assignment and mean.  An assignment searches a vantage-point tree over the entries
of its part position: every node keeps the range of distances from its vantage entry to each branch, rounded
outwards, and a branch is visited wherever its range does not prove every entry in it farther than the best one
(so equal distances are visited too).  Distances that decide are integers; floats only bound.

A round sums its parts within the tasks and then by Spark; only the codebooks (parts x entries x part width integers,
whatever the rows) reach the driver and go back to the tasks.

Defined results: a null vector, and one that holds a null, NaN or infinite component, is dropped; a shorter vector than
the longest is read as if zeros followed, and so is a length that parts don't divide; the first codebooks come from the
smallest ids (equal ids by vector; a null id last), from all rows where there are fewer rows than entries; a null id is
coded like any other; repeated rows are coded alike and each counts in the means; ties go to the lower entry; sums are
exact at any size of component, and an error beyond a long is null, like its label's; an empty table gives no rows;
extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, heavy_join, map_batches

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Share by which a bound gives way, far above the rounding of a square root and of a long as a double.
SLACK = 1e-12
#: Bytes of doubles that are searched together.
GATHERED = 8 << 20
LONG = 2**63


def squared(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distances of integer points from one entry."""
    d = points - entry
    return np.einsum("ij,ij->i", d, d)


class Tree:
    """Vantage-point tree over the integer entries of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        #: Integers beyond longs have no safe double: then every branch is visited.
        self.bounded = entries.dtype != object
        self.root = self._grow(np.arange(len(entries))) if len(entries) else None

    def _grow(self, members: np.ndarray) -> tuple:
        """(vantage entry, its branches as (lowest, highest distance from it, node))."""
        vantage, rest = members[0], members[1:]
        if not len(rest):
            return vantage, []
        away = squared(self.entries[rest], self.entries[vantage])
        order = np.argsort(away, kind="stable")
        branches = []
        for half in np.array_split(order, 2):
            if len(half):
                low, high = (math.sqrt(away[half[k]]) if self.bounded else 0.0 for k in (0, -1))
                branches.append((low * (1 - SLACK), high * (1 + SLACK), self._grow(rest[half])))
        return vantage, branches

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of every point, the lower of equals, and its squared distance."""
        found = np.full(len(points), len(self.entries), np.int64)
        best = np.zeros(len(points), points.dtype)
        self._visit(self.root, points, np.arange(len(points)), found, best)
        return found, best

    def _visit(self, node: tuple, points, rows, found, best) -> None:
        vantage, branches = node
        away = squared(points[rows], self.entries[vantage])
        closer = (found[rows] == len(self.entries)) | (away < best[rows]) | ((away == best[rows]) & (vantage < found[rows]))
        best[rows[closer]], found[rows[closer]] = away[closer], vantage
        if not branches:
            return
        away = np.sqrt(away.astype(np.float64)) if self.bounded else np.zeros(len(rows))
        beside = [np.maximum(np.maximum(low - away * (1 + SLACK), away * (1 - SLACK) - high), 0.0) for low, high, _ in branches]
        near = beside[0] <= beside[-1]
        # Each point's nearer branch first, so that the other one is tested against a better best.
        for nearer_turn in (True, False):
            for k, (_, _, child) in enumerate(branches):
                turn = (near if k == 0 else ~near) == nearer_turn
                reach = beside[k][turn] <= np.sqrt(best[rows[turn]].astype(np.float64)) * (1 + SLACK) if self.bounded else slice(None)
                wanted = rows[turn][reach]
                if len(wanted):
                    self._visit(child, points, wanted, found, best)


def as_integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as longs, or as Python integers where a squared distance could leave the longs."""
    if not vectors.size or np.abs(vectors).max() * float(scale) < safe(vectors.shape[1]):
        return np.floor(vectors * float(scale)).astype(np.int64)
    exact = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * float(scale)) for x in vectors.ravel().tolist()]
    return np.array(exact, object).reshape(vectors.shape)


def safe(width: int) -> int:
    """Integers below this keep the squared distance of two vectors within a long."""
    return math.isqrt(LONG // max(1, 4 * width)) - 1


def matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """Rows of raw floats as doubles, with zeros after the end of short ones."""
    rows = column.to_pylist()
    size = width * np.dtype(kind).itemsize
    return np.frombuffer(b"".join(r if len(r) == size else r.ljust(size, b"\0") for r in rows), kind).reshape(len(rows), width).astype(np.float64)


def packed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame, str]:
    """id, label, vector of the vectors that are kept, as arrays and as raw floats, and the kind of the floats."""
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    kind = "<f4" if single else "<f8"
    usable = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    usable = usable.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def run(batches):
        for b in batches:
            col = b.column("vector")
            ends = np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))]) * np.dtype(kind).itemsize
            values = np.ascontiguousarray(col.flatten().to_numpy(zero_copy_only=False), kind)
            raw = pa.Array.from_buffers(pa.large_binary(), len(col), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), raw.cast(pa.binary())], ["id", "label", "vector"])

    types = {c: vectors.schema[c].dataType.simpleString() for c in (id_col, label_col)}
    return usable, map_batches(usable, run, f"id {types[id_col]}, label {types[label_col]}, vector binary"), kind


def gathered(batches, width: int):
    """The batches put together to about GATHERED bytes: a search's fixed cost is by batch, not by row."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n * width * 8 >= GATHERED:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


class Coder:
    """What a task needs to code vectors: codebooks[part][entry] are lists of integers."""

    def __init__(self, codebooks: list, width: int, kind: str, scale: int):
        self.codebooks, self.width, self.kind, self.scale = codebooks, width, kind, scale

    def start(self):
        """Builds the trees, of longs where that is safe, and of Python integers."""
        wide = [Tree(np.array(c, object).reshape(len(c), self.width // len(self.codebooks))) for c in self.codebooks]
        most = max((abs(x) for c in self.codebooks for e in c for x in e), default=0)
        self.trees = {True: wide, False: [Tree(t.entries.astype(np.int64)) for t in wide] if most < safe(self.width) else wide}

    def parts(self, column: pa.Array):
        """(tree, part of every row) for each part position."""
        whole = as_integers(matrix(column, self.width, self.kind), self.scale)
        trees = self.trees[whole.dtype == object]
        if trees[0].entries.dtype == object:
            whole = whole.astype(object)
        step = self.width // len(trees)
        return [(tree, whole[:, k * step : (k + 1) * step]) for k, tree in enumerate(trees)]


def limbs(total: int):
    """(power, digits) whose digits times 2 ** (32 * power) add up to total: longs that Spark can sum."""
    power = 0
    while not -(2**31) <= total < 2**31:
        yield power, total & 0xFFFFFFFF
        total, power = total >> 32, power + 1
    yield power, total


def refined(rows: DataFrame, coder: Coder) -> list:
    """The codebooks with every entry that some part is nearest to replaced by the mean of these, floored."""
    step = coder.width // len(coder.codebooks)

    def run(batches):
        coder.start()
        counts: dict = {}
        totals: dict = {}
        for b in gathered(batches, coder.width):
            for k, (tree, points) in enumerate(coder.parts(b.column("vector"))):
                found, _ = tree.nearest(points)
                order = np.argsort(found, kind="stable")
                entries, starts, sizes = np.unique(found[order], return_index=True, return_counts=True)
                for entry, total, n in zip(entries.tolist(), np.add.reduceat(points[order], starts).tolist(), sizes.tolist(), strict=True):
                    counts[k, entry] = counts.get((k, entry), 0) + n
                    totals[k, entry] = [x + y for x, y in zip(totals.get((k, entry), [0] * step), total, strict=True)]
        out = [(k, e, -1, 0, n) for (k, e), n in counts.items()] + [(k, e, place, *digits) for (k, e), total in totals.items() for place, x in enumerate(total) for digits in limbs(x)]
        names = ["part", "entry", "place", "power", "digits"]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate([pa.int32()] * 4 + [pa.int64()])], names)

    sums = map_batches(rows.select("vector"), run, "part int, entry int, place int, power int, digits long").groupBy("part", "entry", "place", "power").agg(F.sum("digits").alias("digits"))
    books = [[list(e) for e in c] for c in coder.codebooks]
    count, total = {}, {}
    for part, entry, place, power, digits in sums.collect():  # as many as the codebooks have integers, whatever the rows
        if place < 0:
            count[part, entry] = digits
        else:
            total[part, entry, place] = total.get((part, entry, place), 0) + (digits << 32 * power)
    for (part, entry, place), x in total.items():
        books[part][entry][place] = x // count[part, entry]
    return books


def coded(rows: DataFrame, coder: Coder, id_type: str, label_type: str) -> DataFrame:
    """id, label, code, error of every row."""

    def run(batches):
        coder.start()
        for b in gathered(batches, coder.width):
            pairs = [tree.nearest(points) for tree, points in coder.parts(b.column("vector"))]
            codes = np.stack([f for f, _ in pairs], axis=1).astype(np.uint8)
            errors = [int(x) for x in sum(e for _, e in pairs)]
            cols = [b.column("id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([x if x < LONG else None for x in errors], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "label", "code", "error"])

    return map_batches(rows, run, f"id {id_type}, label {label_type}, code string, error long")


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, list]:
    """(id_col, label_col, code, error of every kept vector; the final codebooks); at most 256 entries."""
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a code is one byte a part: 1 to 256 entries, and a part at least")
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    usable, rows, kind = packed(vectors, id_col, vector_col, label_col)
    rows = cut(rows)
    longest = (rows.agg(F.max(F.octet_length("vector"))).first()[0] or 0) // np.dtype(kind).itemsize
    step = -(-longest // parts)
    first = usable.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    raw = pa.array([np.array(r["vector"], kind).tobytes() for r in first], pa.binary())
    whole = as_integers(matrix(raw, step * parts, kind), scale).tolist()
    books = [[row[k * step : (k + 1) * step] for row in whole] for k in range(parts)]
    if first:
        for _ in range(rounds):
            books = refined(rows, Coder(books, step * parts, kind, scale))
    out = coded(rows, Coder(books, step * parts, kind, scale), id_type, label_type)
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error"), books


def codebooks_digest(books: list) -> str:
    """Hex digest of all entries' integers by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for c in books for e in c for x in e).encode()).hexdigest()


def label_errors(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """codes with label_error, the sum of error over the rows of equal label (nulls together)."""
    key = [F.col(label_col).isNull().alias("__none"), F.coalesce(F.col(label_col).cast("string"), F.lit("")).alias("__label")]
    rows = cut(codes.select("*", *key))
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = rows.groupBy("__none", "__label").agg(F.when(F.count("error") == F.count("*"), whole).try_cast("long").alias("label_error"), F.count("*").alias("__n"))
    return heavy_join(rows, cut(sums), ["__none", "__label"], "__n").drop("__none", "__label")
