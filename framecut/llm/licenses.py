"""License scans: one Aho-Corasick pass finds identifier tags and notice phrases; tag expressions are parsed.

Text is reduced to lower-case words joined by single spaces, so a phrase is found where its
words stand consecutively, whatever stands between them.  A tag (``SPDX-License-Identifier``)
is followed in the original text by an expression of identifiers, AND, OR, WITH and brackets,
which a shunting-yard parser turns to postfix order and evaluates.

Defined results: a null or empty text has no words, no places and score 0; repeated rows give
repeated results; all places count, overlapping ones too; a text of any length is scanned whole in
one pass; of several freedoms the smallest is the score; a tag without a well-formed expression adds
nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM, map_batches, utf8

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notice phrases that the method adds, and their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "creative commons attribution": "cc-by",
    "cc by 4 0": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "proprietary",
}

TAG = "spdx license identifier"

#: How freely text under a license can be reused, from 0 to 1; other identifiers count UNKNOWN.
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "mit": 0.95, "isc": 0.95, "bsd": 0.95, "zlib": 0.95, "bsl": 0.95,
    "apache": 0.9, "cc-by": 0.85, "mpl": 0.6, "epl": 0.6, "lgpl": 0.55, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3,
    "cc-by-nd": 0.2, "cc-by-nc": 0.15, "proprietary": 0.0,
}
UNKNOWN, EXCEPTION_BONUS = 0.5, 0.1

RANK = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9.+-]+)")
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"


def family(identifier: str) -> str:
    """The label of an identifier: its longest known prefix of dash-joined parts, else itself without version."""
    parts = identifier.lower().rstrip("+").split("-")
    for k in range(len(parts), 0, -1):
        if (name := "-".join(parts[:k])) in FREEDOM:
            return name
    return "-".join(p for p in parts if not re.fullmatch(r"[0-9.]+|only|or|later", p)) or identifier.lower()


def postfix(text: str) -> list[str]:
    """Shunting-yard: the longest well-formed expression that text starts with, in postfix order; empty if none."""
    tokens: list[str] = []
    best: list[str] = []
    operand, depth, at = True, 0, 0
    while m := TOKEN.match(text, at):
        token, at = m[1], m.end()
        is_operator = token.lower() in RANK
        if operand and token == "(":
            depth += 1
        elif operand and token != ")" and not is_operator:
            operand = False
        elif not operand and token == ")" and depth:
            depth -= 1
        elif not operand and is_operator:
            operand = True
        else:
            break
        tokens.append(token)
        if not operand and not depth:
            best = list(tokens)
    out: list[str] = []
    held: list[str] = []
    for token in best:
        rank = RANK.get(token.lower())
        if token == "(":
            held.append(token)
        elif token == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif rank:
            while held and held[-1] != "(" and RANK[held[-1]] >= rank:
                out.append(held.pop())
            held.append(token.lower())
        else:
            out.append(token)
    return out + held[::-1]


def evaluate(rpn: list[str]) -> tuple[set[str], float]:
    """Labels of an expression, and its freedom: OR takes the freer side, AND the stricter, WITH adds an exception."""
    stack: list[tuple[set[str], float]] = []
    for token in rpn:
        if token in RANK:
            (right, b), (left, a) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, min(1.0, a + EXCEPTION_BONUS)))
            else:
                stack.append((left | right, max(a, b) if token == "or" else min(a, b)))
        else:
            label = family(token)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN)))
    return stack[0]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in {**{p: (v, "notice") for p, v in NOTICES.items()}, **{p: (v, "base") for p, v in BASE.items()}, TAG: ("", "tag")}.items():
        found.add_word(f" {phrase} ", (label, phrase.count(" ") + 1))
    found.make_automaton()
    return found


def expression_at(text: bytes, at: int) -> str:
    """What follows a tag that ends at this byte, up to the end of its line."""
    end = text.find(b"\n", at)
    return text[at : end if end >= 0 else len(text)].decode("utf-8", "replace").lstrip(" \t:=\"'")


def scan(text: bytes) -> tuple:
    """The values of FIELDS for one text."""
    words = text.translate(ALNUM).split()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base, base_labels, labels, freedoms, expressions = [], set(), set(), [], []
    ends: list[int] = []  # of the words in the text, listed once if there is a tag
    at = spaces = 0
    for end, ((label, kind), n) in automaton().iter(joined):
        start = end  # the last character of the match is the space after its last word
        spaces += joined.count(" ", at, start)
        at = start
        first = spaces - n  # words before the match
        if kind == "tag":
            ends = ends or [m.end() for m in WORD.finditer(text)]
            if rpn := postfix(expression_at(text, ends[first + n - 1])):
                found, freedom = evaluate(rpn)
                labels |= found
                freedoms.append(freedom)
                expressions.append(" ".join(rpn))
            continue
        labels.add(label)
        freedoms.append(FREEDOM[label])
        if kind == "base":
            base.append(first)
            base_labels.add(label)
    return (len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), min(freedoms, default=0.0), expressions)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and FIELDS.  Narrow: no shuffle, nothing kept between rows."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            cols = list(zip(*map(scan, utf8(b, text_col)), strict=True)) or [[]] * 8
            kinds_ = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
            arrays = [b.column(id_col), *(pa.array(list(c), t) for c, t in zip(cols, kinds_, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions"])

    return map_batches(docs.select(id_col, text_col), run, f"{id_col} {kind}, {FIELDS}")
