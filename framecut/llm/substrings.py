"""Substring dedup: every word inside a passage of ``window`` words that starts anywhere else goes.

``repeated_words`` handles a corpus against itself, ``remove_known`` a corpus against a bounded
reference by broadcast suffix automata.  Plan of ``repeated_words``; texts are keyed by two
64-bit hashes:

1. One pass picks anchors: the smallest hash of 8-word grams in each window.  Equal windows pick
   equal anchors, so a window can only repeat if its anchor does.  Anchors are about 7% of words.
2. Anchors are counted with map-side combine.  The passages around the most frequent ones, each
   from one text, are the reference: at most HOT_ANCHORS of them, so its automaton's size is bounded.
3. Texts with a repeated anchor are read once more.  Matching statistics against the reference
   find the windows of frequent passages: these stand in the reference's text too, so they go, and
   each task reports each of them once.  The other windows around repeated anchors give 64-bit
   fingerprints, which are counted with map-side combine; repeated ones come back to their texts.  A
   window that a text itself repeats goes anyway and is reported once, so no text floods a count.
   An automaton over all repeated passages could neither be broadcast nor built within the limits
   (see the README), so fingerprints are the exact way for what is beyond the reference.

A text that occurs more than once is removed wholly (if it has a window) and stands in steps
1-3 once.  No group of equal keys meets in one task: all groups are counts and minima.

Defined results: null and empty texts have no words; texts shorter than the window lose
nothing; a text of any length is read whole; of equal anchors in a window the first counts, which
changes no result; repeated rows count as occurrences of each other; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, gram_hashes, heavy_join, map_batches, text_keys, utf8

WINDOW = 35
GRAM = 8
#: Texts from which an anchor counts as frequent, and the anchors whose passages (under 2 * window words each) form the reference.
HOT_TEXTS, HOT_ANCHORS = 32, 2_000


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of words, the position and value of its smallest gram hash (the first of equal ones)."""
    gram = min(GRAM, window)
    grams = gram_hashes(h, gram)
    width = window - gram + 1
    if len(grams) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    parts = []
    for k in range(0, len(grams) - width + 1, 65536):  # in parts, so that a very long text needs little memory
        low = sliding_window_view(grams[k : k + 65536 + width - 1], width).argmin(axis=1)
        parts.append(low + np.arange(k, k + len(low)))
    at = np.concatenate(parts)
    return at, grams[at]


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def repeated_words(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", hot_texts: int = HOT_TEXTS) -> DataFrame:
    """id_col, n_words, n_removed, kept_sha256, spans (removed [start, end) words) for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col), F.col(text_col).alias("text"), *text_keys(F.col(text_col)))

    def first(batches):
        hashes = WordHashes()
        for b in batches:
            n, sha, found = [], [], []
            for t in utf8(b, "text"):
                words = t.split()
                n.append(len(words))
                sha.append(digest(words))
                at, value = anchors(hashes.of(words), window)
                keep = np.r_[True, at[1:] != at[:-1]] if len(at) else slice(0)
                found.append(value[keep].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("__k1"), b.column("__k2"), pa.array(n, pa.int64()), pa.array(sha), pa.array(found, pa.list_(pa.int64()))], [id_col, "__k1", "__k2", "n", "sha", "anchors"])

    rows = cut(map_batches(keyed, first, f"{id_col} {kind}, __k1 long, __k2 long, n long, sha string, anchors array<long>"))
    key = ["__k1", "__k2"]
    texts = rows.where(F.col("n") >= window).groupBy(*key).agg(F.count("*").alias("copies"), F.min(id_col).alias("__first"), F.first("anchors").alias("anchors"))
    texts = cut(texts)
    seen = texts.select(*key, F.explode("anchors").alias("anchor"))
    again = cut(seen.groupBy("anchor").agg(F.count("*").alias("c"), F.min(F.struct(*key)).alias("one")).where("c > 1"))
    hot = again.where(F.col("c") >= hot_texts).orderBy(F.col("c").desc(), "anchor").limit(HOT_ANCHORS)
    passages = frequent_passages(keyed, hot.select("one.*", "anchor"), window)
    share, token = docs.sparkSession.sparkContext.broadcast(passages), uuid.uuid4().hex
    hits = seen.join(again.select("anchor"), "anchor", "left_semi").groupBy(*key).agg(F.collect_set("anchor").alias("hits"))
    # Among the rows of one text any can stand for it; the smallest id does (all of its rows, should they repeat).
    hits = hits.join(texts.select(*key, "__first"), key).withColumnsRenamed({"__k1": "h1", "__k2": "h2"})
    picked = keyed.join(hits, (F.col("__k1") == F.col("h1")) & (F.col("__k2") == F.col("h2")) & F.col(id_col).eqNullSafe(F.col("__first"))).select(*key, "text", "hits").dropDuplicates(key)

    def second(batches):
        hashes, reference, owners, frequent = WordHashes(), None, set(), set()
        if share.value:
            reference = automaton_of(token, share.value)
            owners, frequent = {p[:2] for p in share.value}, {p[2] for p in share.value}
        reported: set[int] = set()
        for b in batches:
            starts, prints, sure = [], [], []
            for t, k1, k2, wanted in zip(utf8(b, "text"), *(b.column(c).to_pylist() for c in ("__k1", "__k2", "hits")), strict=True):
                words = t.split()
                h = hashes.of(words)
                _, value = anchors(h, window)
                at = np.flatnonzero(np.isin(value.view(np.int64), np.array(wanted, np.int64)))
                grams = gram_hashes(h, window).view(np.int64)
                known = np.empty(0, np.int64)
                if reference and (k1, k2) not in owners and not frequent.isdisjoint(wanted):
                    known = np.flatnonzero(np.array(reference.matches(words)) >= window) - (window - 1)
                    at = np.setdiff1d(at, known, assume_unique=True)
                # A window that stands in this text twice goes without being counted elsewhere; it is reported once.
                _, back, times = np.unique(grams[at], return_inverse=True, return_counts=True)
                own, at = at[times[back] > 1], at[times[back] == 1]
                once = list(dict.fromkeys(grams[own].tolist())) + [g for g in dict.fromkeys(grams[known].tolist()) if g not in reported]
                reported.update(grams[known].tolist())
                sure.append(np.union1d(known, own).astype(np.int32))
                starts.append(np.r_[at, np.full(len(once), -1)].astype(np.int32))
                prints.append(np.r_[grams[at], np.array(once, np.int64)])
            yield pa.RecordBatch.from_arrays([b.column("__k1"), b.column("__k2"), b.column("text"), *(pa.array(x, pa.list_(t)) for x, t in ((starts, pa.int32()), (prints, pa.int64()), (sure, pa.int32())))], ["__k1", "__k2", "text", "starts", "prints", "sure"])

    windows = cut(map_batches(picked, second, "__k1 long, __k2 long, text string, starts array<int>, prints array<long>, sure array<int>"))
    each = windows.select(*key, F.explode(F.arrays_zip("starts", "prints")).alias("w")).select(*key, F.col("w.starts").alias("start"), F.col("w.prints").alias("print"))
    twice = each.groupBy("print").agg(F.count("*").alias("c")).where("c > 1").select("print")
    starts = each.where("start >= 0").join(twice, "print", "left_semi").groupBy(*key).agg(F.collect_list("start").alias("found"))

    def third(batches):
        for b in batches:
            spans, removed, sha = [], [], []
            for t, found, sure in zip(utf8(b, "text"), b.column("found").to_pylist(), b.column("sure").to_pylist(), strict=True):
                words = t.split()
                spans.append(joined_spans(sorted({*(found or ()), *sure}), window))
                kept, at = [], 0
                for a, e in spans[-1]:
                    kept += words[at:a]
                    at = e
                kept += words[at:]
                removed.append(len(words) - len(kept))
                sha.append(digest(kept))
            flat = [[x for s in p for x in s] for p in spans]
            yield pa.RecordBatch.from_arrays([b.column("__k1"), b.column("__k2"), pa.array(removed, pa.int64()), pa.array(sha), pa.array(flat, pa.list_(pa.int64()))], ["__k1", "__k2", "removed", "new_sha", "spans"])

    changed = map_batches(windows.select(*key, "text", "sure").join(starts, key, "left").where("found is not null or size(sure) > 0"), third, "__k1 long, __k2 long, removed long, new_sha string, spans array<long>")
    result = texts.select(*key, "copies").join(changed, key, "left").where("copies > 1 or removed > 0")
    copies = F.col("copies") > 1
    # Many rows may share a text: those of the most frequent ones don't meet in one task.
    return heavy_join(rows.drop("anchors"), cut(result.withColumn("n_copies", F.col("copies"))), key, "n_copies").select(
        F.col(id_col),
        F.col("n").alias("n_words"),
        F.when(copies, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copies, F.lit(digest([]))).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256"),
        F.when(copies, F.array(F.lit(0).cast("long"), F.col("n"))).otherwise(F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"),
    )


def frequent_passages(keyed: DataFrame, hot: DataFrame, window: int) -> list[tuple[int, int, int, list[bytes]]]:
    """(__k1, __k2, anchor, words) around the first occurrence of each anchor of hot in its text; as many as hot has."""
    key = ["__k1", "__k2"]
    few = hot.groupBy(*key).agg(F.collect_set("anchor").alias("wanted"))
    texts = keyed.select(*key, "text").join(F.broadcast(few), key)

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            out = [[], [], [], []]
            for t, k1, k2, wanted in zip(utf8(b, "text"), *(b.column(c).to_pylist() for c in (*key, "wanted")), strict=True):
                words = t.split()
                at, value = anchors(hashes.of(words), window)
                value = value.view(np.int64)
                for anchor in wanted:
                    first = at[np.flatnonzero(value == anchor)[0]]
                    here = np.flatnonzero((value == anchor) & (at == first))
                    for column, x in zip(out, (k1, k2, anchor, b" ".join(words[here[0] : here[-1] + window])), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], [*key, "anchor", "words"])

    found = map_batches(texts, run, "__k1 long, __k2 long, anchor long, words binary").dropDuplicates([*key, "anchor"])
    return [(r[0], r[1], r[2], bytes(r[3]).split()) for r in found.collect()]


_automata: dict[str, SuffixAutomaton] = {}


def automaton_of(token: str, passages: list) -> SuffixAutomaton:
    """The reference's automaton, built once in a worker."""
    if token not in _automata:
        _automata.clear()
        _automata[token] = SuffixAutomaton([p[3] for p in passages])
    return _automata[token]


def joined_spans(starts: list[int], window: int) -> list[tuple[int, int]]:
    """The maximal spans that windows at these starts cover."""
    out: list[list[int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1][1] = s + window
        else:
            out.append([s, s + window])
    return [tuple(x) for x in out]


class SuffixAutomaton:
    """Suffix automaton over word numbers; documents stream through it for matching statistics."""

    def __init__(self, texts: list[list[bytes]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.numbers: dict[bytes, int] = {}
        for k, words in enumerate(texts):
            last = 0
            for w in words:
                last = self._extend(last, self.numbers.setdefault(w, len(self.numbers)))
            self._extend(last, -1 - k)  # a separator of its own: no match runs from one text into the next

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:  # seen after an earlier text: the automaton of several texts
            q = self.next[last][symbol]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, symbol, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
        return new

    def _split(self, p: int, symbol: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def matches(self, words: list[bytes]) -> list[int]:
        """For each word, the length of the longest passage ending there that the reference holds."""
        out, state, n = [], 0, 0
        for w in words:
            symbol = self.numbers.get(w)
            if symbol is None:
                state = n = 0
            else:
                while state and symbol not in self.next[state]:
                    state = self.link[state]
                    n = self.length[state]
                if symbol in self.next[state]:
                    state, n = self.next[state][symbol], n + 1
                else:
                    n = 0
            out.append(n)
        return out


#: Words behind one broadcast automaton (about 400 bytes each in a worker).
SHARD_WORDS = 200_000


def remove_known(docs: DataFrame, reference: DataFrame, window: int = WINDOW, text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with text_col rid of the maximal spans of at least window words that stand in the reference's texts.

    The reference streams to the driver one partition at a time and is dealt into shards of shard_words; every shard
    is one more narrow pass over the rows.  Meant for a reference of bounded size, such as a list of known passages.
    """
    spark, shards, size = docs.sparkSession, [[]], 0
    for r in reference.select(F.coalesce(text_col, F.lit("")).alias("t")).toLocalIterator():
        words = r["t"].encode().split()
        for k in range(0, max(1, len(words) - window + 1), shard_words):
            part = words[k : k + shard_words + window - 1]
            if size and size + len(part) > shard_words:
                shards.append([])
                size = 0
            shards[-1].append(part)
            size += len(part)
    held = [spark.sparkContext.broadcast(s) for s in shards]
    spots = "__known"
    while spots in docs.columns:
        spots += "_"
    df = docs.withColumn(spots, F.array().cast("array<int>"))

    def scan(share, last: bool):
        def run(batches):
            automaton = SuffixAutomaton(share.value)
            for b in batches:
                ends, texts = [], []
                for t, old, raw in zip(utf8(b, text_col), b.column(spots).to_pylist(), b.column(text_col).to_pylist(), strict=True):
                    words = t.split()
                    full = old + [x for k, n in enumerate(automaton.matches(words)) if n >= window for x in (k - n + 1, k + 1)]
                    ends.append(full)
                    if last and full:
                        gone = np.zeros(len(words) + 1, np.int32)
                        np.add.at(gone, full[::2], 1)
                        np.add.at(gone, full[1::2], -1)
                        raw = b" ".join(w for w, g in zip(words, np.cumsum(gone[:-1]), strict=True) if not g).decode()
                    texts.append(raw)
                cols = [c for c in b.schema.names if c not in (spots, text_col)]
                values = {c: b.column(c) for c in cols} | {text_col: pa.array(texts, b.column(text_col).type), spots: pa.array(ends, pa.list_(pa.int32()))}
                yield pa.RecordBatch.from_arrays([values[c] for c in b.schema.names], b.schema.names)

        return run

    for k, share in enumerate(held):
        df = map_batches(df, scan(share, k == len(held) - 1), df.schema)
    return df.drop(spots)
