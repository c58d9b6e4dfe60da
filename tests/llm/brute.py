"""Plain Python versions of the query contracts."""

import collections
import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted((a, r, k, b) for r, k, a, b in spans))


def secrets(text):
    text = text or ""
    spans = [(0, "assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(1, "access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return spans + [(2, "hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def licenses(text):
    """(words, base places, first, last, base labels)"""
    words = ALNUM.findall(low(text))
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    found = [(k, label) for p, label in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
    at = [k for k, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in found}))


def luhn(number):
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(number))]
    return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    spans = [(0, "email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(1, "ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    spans += [(2, "card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return spans + [(3, "phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]


def quality(text):
    words = SPACED.findall(text or "")
    grams = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    inside = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def components(rows, k, percent=80):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = SPACED.findall(low(t))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def decontaminate(rows, items, window=13):
    owners = collections.defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(low(text))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            owners[tuple(w[k : k + window])].add(str(item))
    out = []
    for i, text in rows:
        w, hit, who = ALNUM.findall(low(text)), set(), set()
        for n in {len(x) for x in owners}:
            for k in range(len(w) - n + 1):
                if found := owners.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    who |= found
        out.append((i, len(w), len(hit), len(who), sha(",".join(sorted(who))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def substrings(rows, window=35):
    words = [(i, SPACED.findall(t or "")) for i, t in rows]
    count = collections.Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for j in range(window)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def targets(sizes):
    """source -> target from source -> size, by the contract's own steps."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    goal, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if goal * weight[s] / total > 2 * sizes[s]]
        if not over:
            out |= {s: goal * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            goal -= out[s]
            free.discard(s)
    return out


def lines_left(rows, min_sites=10, min_chars=1):
    """The lines that stay of each row (id, text, site); None for a null text."""
    sites, first = collections.defaultdict(set), {}
    strip = lambda x: x.strip(" \t\r\x0b\x0c")
    for i, t, s in rows:
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            if len(strip(line)) >= min_chars:
                sites[strip(line)].add(s)
                first[strip(line)] = min(first.get(strip(line), (i, p)), (i, p))
    return [None if t is None else [x for p, x in enumerate(t.split("\n")) if len(sites.get(strip(x), ())) < min_sites or first[strip(x)] == (i, p)] for i, t, _ in rows]


def lines(rows, min_sites=10, min_chars=1):
    """(id, lines, removed, kept text) for rows of (id, text, site)."""
    out = []
    for (i, t, _), kept in zip(rows, lines_left(rows, min_sites, min_chars), strict=True):
        n = len(t.split("\n")) if t is not None else 0
        out.append((i, n, n - len(kept or []), sha("\n".join(kept or []))))
    return out
