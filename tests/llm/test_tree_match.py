"""Tree matching gives the same pairs whatever the lists' sizes."""

import random

from framecut.llm import html


def tree(body):
    return html.skeleton(html.parse(f"<body>{body}</body>"))


def plain_match(a, b):
    """The places matched, by the whole table of every two nodes."""
    below = [html.children(t) for t in (a, b)]

    def table(p, q):
        x, y = below[0][p], below[1][q]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (score(u, v) if a[u].key == b[v].key else 0))
        return best

    def score(p, q):
        return 1 + table(p, q)[-1][-1]

    out = [(0, 0)]
    for p, q in out:
        x, y, best, found = below[0][p], below[1][q], table(p, q), []
        i, j = len(x), len(y)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((x[i], y[j]))
        out.extend(reversed(found))
    return out


def test_long_lists_are_matched_like_short_ones():
    """600 x 600 children: matching the k-th with the k-th crosses, as the second list lacks every third child."""
    part = lambda k, text: f"<section class=s{k % 7}><div>{text}</div>{'<table></table>' * (k % 2)}</section><nav class=n{k % 5}></nav>"
    a = tree("".join(part(k, "a") for k in range(300)))
    b = tree("".join(part(k, "b") for k in range(450) if k % 3))
    got = html.tree_match(a, b)
    assert got == plain_match(a, b)
    tops = [(p, q) for p, q in got if a[p].parent == 1]
    assert tops == sorted(tops) and [q for _, q in tops] == sorted(q for _, q in tops)


def test_any_trees_are_matched_alike(monkeypatch):
    rng = random.Random(3)

    def body(depth):
        return "".join(f"<{t}>{body(depth - 1)}</{t}>" for t in rng.choices(["div", "section", "table", "nav"], k=rng.randint(0, 5))) if depth else ""

    for _ in range(100):
        a, b = tree(body(rng.randint(1, 3))), tree(body(rng.randint(1, 3)))
        want = plain_match(a, b)
        for cells in (1, 250_000):
            monkeypatch.setattr(html, "CELLS", cells)
            assert html.tree_match(a, b) == want


def test_very_long_lists_of_few_shapes_are_matched():
    rng = random.Random(1)
    wide = lambda n: tree("".join(f"<section class=c{rng.randint(0, 3)}><div></div>{'<ul></ul>' * rng.randint(0, 1)}</section><nav></nav>" for _ in range(n)))
    a, b = wide(4000), wide(4000)
    got = html.tree_match(a, b)
    assert html.tree_match(a, a) == [(k, k) for k, _ in html.tree_match(a, a)] and len(html.tree_match(a, a)) == len(a)
    assert len(got) == len(set(p for p, _ in got)) == len(set(q for _, q in got)) and all(a[p].key == b[q].key for p, q in got)
