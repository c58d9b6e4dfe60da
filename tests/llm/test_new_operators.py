"""Vector codes, filter audit and SimHash: against plain versions, and on odd tables."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash

from framecut.llm import filteraudit, queries, simhash, vectorcodes

ODD = [(1, None), (2, ""), (3, "word"), (4, " \n\t "), (5, "Ünï cödé — “x”\nline"), (6, "same text here"), (6, "same text here"), (7, "same text here"), (None, "a text without an id"), (None, "same text here")]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- 11: vector codes


def plain_codes(vectors, parts, entries, rounds, scale):
    """{place in vectors: (code, error)}, codebooks; vectors are (id, list) that are kept."""
    step = -(-max((len(v) for _, v in vectors), default=0) // parts)
    whole = [[math.floor(scale * x) if abs(x) < 1e15 else int(x) * scale for x in v] + [0] * (parts * step - len(v)) for _, v in vectors]
    cut = [[w[k * step : (k + 1) * step] for k in range(parts)] for w in whole]
    first = sorted(range(len(vectors)), key=lambda i: (vectors[i][0] is None, vectors[i][0] or 0, vectors[i][1]))[:entries]
    books = [[list(cut[i][k]) for i in first] for k in range(parts)]
    nearest = lambda k, p: min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), i) for i, e in enumerate(books[k]))
    for _ in range(rounds):
        for k in range(parts):
            groups = collections.defaultdict(list)
            for c in cut:
                groups[nearest(k, c[k])[1]].append(c[k])
            for i, g in groups.items():
                books[k][i] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    out = []
    for c in cut:
        best = [nearest(k, c[k]) for k in range(parts)]
        error = sum(d for d, _ in best)
        out.append(("".join(f"{i:02x}" for _, i in best), error if error < 2**63 else None))
    return out, books


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "x", 5, 1.5) for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string, error int, vector double")


def test_vector_codes_match_plain(spark):
    rng = random.Random(3)
    rows = [(i // 2, [rng.choice([-0.25, 0.0, 0.5, 1 / 3, -7.7]) + rng.randrange(3) for _ in range(12)], rng.choice([None, 1, 2])) for i in range(120)]
    rows += [(500, None, 1), (501, [1.0, None] * 6, 1), (502, [math.nan] * 12, 2), (503, [math.inf] + [0.0] * 11, None), (504, [], 1), (505, [0.5] * 5, 1), (None, [0.1] * 12, 1)]
    rng.shuffle(rows)
    for kind, entries in (("float", 6), ("double", 200)):
        df = vectors_of(spark, rows, kind).repartition(3)
        found, books = vectorcodes.compress(df, parts=4, entries=entries, rounds=3, scale=64)
        kept = [(i, [float(np.float32(x)) if kind == "float" else x for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
        want, want_books = plain_codes([r[:2] for r in kept], 4, entries, 3, 64)
        assert books == want_books
        assert rows_of(found) == sorted(((i, label, *w) for (i, _, label), w in zip(kept, want, strict=True)), key=repr)
        by_label = collections.Counter()
        for (_, _, label), w in zip(kept, want, strict=True):
            by_label[label] += w[1]
        sums = vectorcodes.label_errors(found)
        assert {(r.label, r.label_error) for r in sums.collect()} == set(by_label.items())
        assert sums.count() == len(kept)


def test_vector_codes_beyond_longs(spark):
    rows = [(i, [1e30 * (i % 7), 1.0 * i, -1e300 if i == 4 else 2.0, 0.25], 1) for i in range(9)]
    found, books = vectorcodes.compress(vectors_of(spark, rows, "double"), parts=2, entries=3, rounds=2)
    want, want_books = plain_codes([r[:2] for r in rows], 2, 3, 2, 4096)
    assert books == want_books
    assert [(r.code, r.error) for r in found.orderBy("vec_id").collect()] == want
    assert any(e is None for _, e in want) and any(e is not None for _, e in want)
    assert {r.label_error for r in vectorcodes.label_errors(found).collect()} == {None}


def test_vector_codes_of_few_rows(spark):
    for rows in ([], [(1, None, 1)]):
        found, books = vectorcodes.compress(vectors_of(spark, rows))
        assert found.count() == 0 and books == [[]] * 8
        assert vectorcodes.label_errors(found).count() == 0
    found, books = vectorcodes.compress(vectors_of(spark, [(1, [], 1), (2, [], 1)]))
    assert {(r.code, r.error) for r in found.collect()} == {("00" * 8, 0)}
    with pytest.raises(ValueError, match="256"):
        vectorcodes.compress(vectors_of(spark, []), entries=257)


@pytest.mark.parametrize("seed", range(8))
def test_tree_finds_the_lower_of_the_nearest(seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-3, 4, (rng.integers(1, 40), 3))  # many equal entries and equal distances
    points = rng.integers(-5, 6, (500, 3))
    d = ((points[:, None] - entries[None]) ** 2).sum(2)
    for kind in (np.int64, object):
        found, best = vectorcodes.Tree(entries.astype(kind)).nearest(points.astype(kind))
        assert (found == d.argmin(1)).all() and (best == d.min(1)).all()


def test_tree_skips_branches(monkeypatch):
    """Clusters far apart: most entries are never compared."""
    rng = np.random.default_rng(1)
    entries = (rng.integers(0, 50, (64, 8)) * 10_000).astype(np.int64)
    tree, seen = vectorcodes.Tree(entries), []
    plain = vectorcodes.squared
    monkeypatch.setattr(vectorcodes, "squared", lambda p, e: seen.append(len(p)) or plain(p, e))
    points = entries[rng.integers(0, 64, 400)] + rng.integers(-5, 6, (400, 8))
    found, best = tree.nearest(points)
    assert (best == ((points - entries[found]) ** 2).sum(1)).all() and sum(seen) < 400 * 64 // 2


# --- 12: filter audit

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    ids = collections.defaultdict(list)
    for i, text, _ in docs:
        ids[text or ""].append(i)
    judged = []
    for i, text, part in docs:
        text, known = text or "", [x for x in ids[text or ""] if x is not None]
        w = SPACED.findall(text)
        fails = {f for f, no in zip("ABCDE", [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search("[#$%&*|]", text), i is not None and i > min(known)], strict=True) if no}
        judged.append((part or "", i, fails))
    rows = []
    for part in {p for p, _, _ in judged}:
        mine = [(i, f) for p, i, f in judged if p == part]
        table, shapley = [], collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                failing = sum(f in x[1] for x in mine)
                table.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(x[1] == {f} for x in mine), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f))
        rows += [(*r[:-1], shapley[r[-1]]) for r in table]
    return sorted(rows, key=repr)


def audit(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, "m", "k") for r in docs], "doc_id long, text string, lang string, n int, mask string, key string")
    return filteraudit.filter_audit(d, spark.createDataFrame([(*r, "e") for r in labels], "doc_id long, quality int, toxic int, part string"))


def test_audit_matches_plain(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["Word", "w%d" % rng.randrange(400), "X#", "y"]) for _ in range(rng.choice([3, 99, 100, 101, 160])))
    pool = [text() for _ in range(20)] + [None, "", " \t", "A" * 10 + "b" * 90, "A" * 11 + "b" * 89, "w " * 3000]
    docs = [(rng.choice([None, *range(40)]), rng.choice(pool), rng.choice([None, "", "en", "de"])) for _ in range(150)]
    docs += [(100 + k, " ".join(f"d{j}" for j in range(80)) + " d0" * extra, "edge") for k, extra in enumerate((19, 20, 21))]
    labels = [(i, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i in [None, *range(30), *range(10)]]
    assert rows_of(audit(spark, docs, labels)) == plain_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    assert audit(spark, [], [(1, 1, 1)]).count() == 0
    assert rows_of(audit(spark, [(1, "x", "en")], [])) == plain_audit([(1, "x", "en")], [])


# --- 13: SimHash


def plain_print(text, k):
    w = SPACED.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(items, budget):
    """Sorted (id, print, component) of (id, print) items."""
    prints = np.array(sorted({p for _, p in items}), np.uint64)
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= budget) + i + 1:
            root[find(int(j))] = find(i)
    at = {int(p): k for k, p in enumerate(prints)}
    least = {}
    for i, p in items:
        if i is not None:
            r = find(at[p])
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{p:016x}", least.get(find(at[p]))) for i, p in items), key=repr)


def test_simhash_query_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = plain_components([(i, plain_print(t, 4)) for i, t in docs], 4)
    assert rows_of(queries.QUERIES["op13_simhash_dedup"](spark, sf_dir)) == want
    assert len({c for _, _, c in want}) < len(docs)


def test_simhash_of_odd_rows(docs_of):
    rows = [*ODD, (20, "w " * 40_000), (21, "W\x0bw\x0c" * 20_000)]
    found = simhash.near_duplicates(docs_of(rows), k=4)
    assert rows_of(found) == plain_components([(i, plain_print(t, 4)) for i, t in rows], 4)
    assert simhash.near_duplicates(docs_of([])).count() == 0


def cloud(seed, n, spread):
    """Fingerprints around a few centres, copies among them, others at random."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)]
    out = [0, 2**64 - 1, 2**63]
    for _ in range(n):
        p = rng.choice([*centres, centres[0], rng.getrandbits(64)])
        for b in rng.sample(range(64), rng.randrange(spread)):
            p ^= 1 << b
        out += [p] * rng.choice([1, 1, 3])
    return out


@pytest.mark.parametrize(("spread", "large", "blocks", "budget"), [(8, 2048, None, 4), (8, 8, 5, 4), (4, 8, 6, 4), (12, 20, 7, 4), (6, 4, 3, 2), (5, 16, 1, 0)])
def test_links_however_dealt(spark, monkeypatch, spread, large, blocks, budget):
    """Buckets split by node pairs, more blocks and other budgets give the components of all pairs."""
    items = list(enumerate(cloud(spread + large, 300, spread)))
    signed = lambda p: p - 2**64 if p >= 2**63 else p
    prints = spark.createDataFrame([(i, signed(p)) for i, p in items], "doc long, print long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: prints)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rows_of(simhash.near_duplicates(docs, budget=budget, large=large, blocks=blocks)) == plain_components(items, budget)


def test_traversal_finds_each_pair_once():
    rng = np.random.default_rng(7)
    values = np.unique(np.concatenate([rng.integers(0, 2**63, 200).astype(np.uint64), np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))]))
    i, j = simhash.close_pairs(values, np.array([0]), 4)
    want = {(x, y) for x in range(len(values)) for y in range(x + 1, len(values)) if (int(values[x]) ^ int(values[y])).bit_count() <= 4}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


