"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows, one scan of each text.

Texts and items are reduced to lower-case words.  A window is WINDOW consecutive words of an
item, or a whole shorter item.  The automaton's symbols are word numbers, so a match can only
begin and end between words; word offsets map back to byte offsets of the original text.

The items are broadcast in blocks of at most ``block_bytes``; more items mean more blocks, each
scanned in one more narrow pass over the same rows, and no row is shuffled.  All blocks together, and so the
memory of the driver and the workers, grow with the benchmark, not with the texts.

Defined results: null and empty items make no window; a null item_id counts as the empty string; null and empty texts have no hit; equal
items each count; a text of any length is scanned whole; items that share a window all count; repeated
rows give repeated results; an empty table gives no rows; extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, map_batches, utf8

WINDOW = 13
#: A document is contaminated when hit words make at least one part in MIN_SHARE of its words.
MIN_SHARE = 20
#: Bytes of item text behind one automaton.
BLOCK_BYTES = 4_000_000
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Scanner:
    """Automaton of one block of items (item id as string, text)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            seq = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in alnum_words(text)]
            for k in range(max(1, len(seq) - window + 1) if seq else 0):
                owners.setdefault(tuple(seq[k : k + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, who in owners.items():
            self.automaton.add_word(pattern, (len(pattern), sorted(who)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, end, items) of every occurrence."""
        if self.empty or not words:
            return
        get = self.numbers.get
        for end, (n, who) in self.automaton.iter(tuple(get(w, 0) for w in words)):
            yield end - n + 1, end + 1, who


def hit_words(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Mask of the words inside spans."""
    change = np.zeros(n + 1, np.int32)
    for a, b in spans:
        change[a] += 1
        change[b] -= 1
    return np.cumsum(change[:-1]) > 0


def joined(spans) -> list[tuple[int, int]]:
    """The maximal spans that spans cover together, neighbours joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def byte_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as byte offsets of the original text."""
    if not spans:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[list[tuple[str, bytes]]]:
    """The items in blocks of at most block_bytes (a longer item alone); the stream holds one partition at a time."""
    blocks, size = [[]], 0
    rows = items.select(F.col(item_col).cast("string").alias("i"), F.coalesce(text_col, F.lit("")).alias("t")).where(F.col("t") != "")
    for r in rows.toLocalIterator():
        text = r["t"].encode()
        if blocks[-1] and size + len(text) > block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append((r["i"] or "", text))
        size += len(text)
    return blocks


def judge(docs: DataFrame, items: DataFrame, out_cols: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, keep_clean: bool = False) -> DataFrame:
    """out_cols of docs with n_words, n_hit, n_items, items_sha256, contaminated and places ([start, end) bytes of hit passages in the text); or, with keep_clean, the clean rows alone."""
    blocks = item_blocks(items, item_col, item_text, block_bytes)
    spark = docs.sparkSession
    held = [spark.sparkContext.broadcast(b) for b in blocks]
    df = docs.select(*{c: None for c in [*out_cols, text_col]})
    extra = pa.list_(pa.string())
    held_hits = "__hits"
    while held_hits in docs.columns:
        held_hits += "_"

    def scan(k: int, last: bool):
        share = held[k]

        def run(batches):
            scanner = Scanner(share.value)
            for b in batches:
                before = b.column(held_hits).to_pylist() if k else [[]] * b.num_rows
                columns = [[] for _ in range(6)]
                hits = []
                for text, old in zip(utf8(b, text_col), before, strict=True):
                    words = alnum_words(text)
                    spans = {tuple(map(int, x.split(":", 2)[:2])) for x in old if x[0] != "i"}
                    who = {x[1:] for x in old if x[0] == "i"}
                    for a, e, items_ in scanner.matches(words):
                        spans.add((a, e))
                        who.update(items_)
                    if not last:
                        hits.append([f"{a}:{e}" for a, e in spans] + [f"i{w}" for w in who])
                        continue
                    n_hit = int(hit_words(len(words), list(spans)).sum()) if spans else 0
                    digest = hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()
                    places = [] if keep_clean else byte_spans(text, joined(spans))
                    for c, v in zip(columns, (len(words), n_hit, len(who), digest, n_hit > 0 and MIN_SHARE * n_hit >= len(words), places), strict=True):
                        c.append(v)
                if not last:
                    kept = [c for c in b.schema.names if c != held_hits]
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(hits, extra)], [*kept, held_hits])
                elif keep_clean:
                    yield b.select(out_cols).filter(pa.array([not x for x in columns[4]], pa.bool_()))
                else:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out_cols), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [*out_cols, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "places"])

        return run

    base = docs.select(*out_cols).schema
    for k in range(len(held)):
        last = k == len(held) - 1
        if not last:
            schema = docs.select(*{c: None for c in [*out_cols, text_col]}).schema.add(held_hits, T.ArrayType(T.StringType()))
        elif keep_clean:
            schema = base
        else:
            schema = docs.select(*out_cols).schema
            for f, t in (("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean"), ("places", "array<array<long>>")):
                schema = schema.add(f, T._parse_datatype_string(t) if "<" in t else t)
        df = map_batches(df, scan(k, last), schema)
    return df


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: its id and what the benchmark's windows hit."""
    return judge(docs, items, [id_col], text_col, **options)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    return judge(docs, items, docs.columns, text_col, keep_clean=True, **options)
