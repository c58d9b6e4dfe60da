"""Quality rules: how much of a text repeats itself, by rolling hashes of several n-gram lengths in numpy.

Words are runs of characters other than space and \\t-\\r.  For each n-gram length the characters
inside duplicated n-grams are measured against all word characters, and likewise the characters
of duplicated lines.  The verdict rejects a text when one share passes its limit.

Defined results: a null or empty text has no words and fails; a text shorter than an n-gram has
no duplicate of that length; the first of equal lines is not a duplicate; a share equal to its limit
passes; a text of any length is measured whole; repeated rows are judged alike; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordHashes, gram_hashes, map_batches, utf8

MIN_WORDS = 10
#: Largest share, in percent, of words in 5-word windows found twice or more.
MAX_REPEAT_WORDS = 20
#: n-gram length: largest share, in percent, of word characters inside duplicated n-grams.
MAX_GRAM_CHARS = {5: 30, 7: 28, 10: 25}
#: Largest share, in percent, of word characters inside lines equal to an earlier line.
MAX_LINE_CHARS = 30

SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
CONTINUATION = bytes(range(0x80, 0xC0))
FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("dup_line_chars", pa.int64()), *((f"dup_{n}gram_chars", pa.int64()) for n in MAX_GRAM_CHARS)]
SPARK_KIND = {pa.int64(): "long", pa.bool_(): "boolean"}


def n_chars(text: bytes) -> int:
    """Code points of UTF-8 bytes: all bytes but continuation bytes."""
    return len(text) if text.isascii() else len(text.translate(None, CONTINUATION))


def covered(grams: np.ndarray, n: int, size: int) -> np.ndarray | None:
    """Mask of the words inside n-grams found twice or more; None if there are none."""
    if len(grams) < 2:
        return None
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return None
    starts = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, grams), len(twice) - 1)] == grams)
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + n, -1)
    return np.cumsum(change[:-1]) > 0


def measure(text: bytes, hashes: WordHashes) -> tuple:
    """The values of FIELDS for one text."""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, len(text.translate(None, NOT_SYMBOLS)), 0, 0, True, False, 0, *[0] * len(MAX_GRAM_CHARS))
    sizes = np.fromiter(map(len, words), np.int64, n) if text.isascii() else np.fromiter(map(n_chars, words), np.int64, n)
    total = int(sizes.sum())
    seen: set[bytes] = set()
    dup_lines = line_chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup_lines += 1
            line_chars += n_chars(b"".join(line.split()))
        elif line.strip(b" \t\n\r\x0b\x0c"):
            seen.add(line)
    h = hashes.of(words)
    repeat, grams = 0, []
    for k in MAX_GRAM_CHARS:
        mask = covered(gram_hashes(h, k), k, n)
        grams.append(0 if mask is None else int(sizes[mask].sum()))
        if k == 5 and mask is not None:
            repeat = int(mask.sum())
        if mask is None:  # no n-gram is repeated, so no longer one is
            grams += [0] * (len(MAX_GRAM_CHARS) - len(grams))
            break
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_WORDS * n
    kept = not failed and 100 * line_chars <= MAX_LINE_CHARS * total and all(100 * g <= most * total for g, most in zip(grams, MAX_GRAM_CHARS.values(), strict=True))
    return (n, total, len(text.translate(None, NOT_SYMBOLS)), dup_lines, repeat, failed, kept, line_chars, *grams)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, the measures and the verdict.  Narrow: no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            cols = list(zip(*(measure(t, hashes) for t in utf8(b, text_col)), strict=True)) or [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([b.column(id_col), *(pa.array(list(c), t) for c, (_, t) in zip(cols, FIELDS, strict=True))], [id_col, *(f for f, _ in FIELDS)])

    return map_batches(docs.select(id_col, text_col), run, f"{id_col} {kind}, " + ", ".join(f"{f} {SPARK_KIND[t]}" for f, t in FIELDS))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            yield b.filter(pa.array([measure(t, hashes)[6] for t in utf8(b, text_col)], pa.bool_()))

    return map_batches(docs, run, docs.schema)
