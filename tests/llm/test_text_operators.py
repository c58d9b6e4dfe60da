import random
import time

import brute
import pytest
from pyspark.sql import functions as F

from framecut.llm import decontaminate, html, licenses, lines, mixing, neardup, pii, quality, queries, secrets, spans, substrings

ODD = [(1, None), (2, ""), (3, "word"), (4, " \n\t "), (5, "Ünï cödé — “x”\nline\nline"), (6, "same text here"), (6, "same text here"), (None, "a text without an id")]


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def long_text(seed, n=300, vocabulary=5000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- 1: licences


def test_license_places_and_labels(docs_of):
    rows = [*ODD, (10, "The MIT-License, and the mit license."), (11, "GNU General\nPublic License"), (12, "Apache License general public license " * 3)]
    got = by_id(licenses.license_scan(docs_of(rows)))
    assert (got[10].n_base, got[10].first_word, got[10].last_word, got[10].base_labels) == (2, 1, 5, "mit")
    assert (got[11].n_base, got[11].base_labels, got[11].labels) == (1, "gpl", "gpl")
    assert (got[12].n_base, got[12].first_word, got[12].last_word, got[12].base_labels) == (6, 0, 12, "apache,gpl")
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].score) == (0, 0, None, 0.0)


@pytest.mark.parametrize(
    ("text", "rpn"),
    [
        ("MIT", ["MIT"]),
        ("MIT OR Apache-2.0 AND BSD-3-Clause", ["MIT", "Apache-2.0", "BSD-3-Clause", "and", "or"]),
        ("(MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND ISC", ["MIT", "GPL-2.0-only", "Classpath-exception-2.0", "with", "or", "ISC", "and"]),
        ("MIT OR Apache-2.0 */ int main", ["MIT", "Apache-2.0", "or"]),
        ("MIT AND", ["MIT"]),
        ("(MIT", []),
        ("AND MIT", []),
        ("", []),
    ],
)
def test_shunting_yard(text, rpn):
    assert licenses.postfix(text) == rpn


def test_license_expression_scores(docs_of):
    rows = [(1, "x\n# SPDX-License-Identifier: MIT OR GPL-3.0-only\ncode"), (2, "SPDX-License-Identifier: (MIT AND GPL-3.0-only)"), (3, "spdx license identifier:\nMIT"), (4, "SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note")]
    got = by_id(licenses.license_scan(docs_of(rows)))
    assert [got[k].labels for k in (1, 2, 3, 4)] == ["gpl,mit", "gpl,mit", "", "gpl"]
    assert [round(got[k].score, 2) for k in (1, 2, 3, 4)] == [0.95, 0.4, 0.0, 0.5]
    assert all(r.n_base == 0 for r in got.values())


def test_license_query_matches_brute_force(spark, docs_of, sf_dir):
    known = [(1, "MIT licenseMIT license mit. LICENSE"), (2, "x " * 50_000 + "Apache License; general public license general public license"), *ODD]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    cols = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert rows_of(licenses.license_scan(docs_of(known)), *cols) == sorted(((i, *brute.licenses(t)) for i, t in known), key=repr)
    found = queries.QUERIES["op1_license_scan"](spark, sf_dir)
    assert rows_of(found, *cols) == sorted(((i, *brute.licenses(t)) for i, t in docs), key=repr)
    assert licenses.license_scan(docs_of([])).count() == 0


# --- 2 and 5: spans


def test_secret_base_spans(docs_of):
    rows = [*ODD, (10, "é token = \"abcdef\" API_KEY:xyz12345 secret=ab token: token: abcdefgh"), (11, "AKIA" + "A1" * 9 + " " + "0f" * 15 + " AKIAAKIA"), (12, "x" * 5000 + " PassWd='q/w+e_r.t=y-' " + "ab" * 3000)]
    found = secrets.secret_scan(docs_of(rows))
    got = {(r.doc_id, r.s) for r in found.select("doc_id", spans.joined(F.col("base")).alias("s")).collect()}
    assert got == {(i, brute.joined(brute.secrets(t))) for i, t in rows}


def test_secret_model_tells_random_from_ordinary(docs_of):
    rng = random.Random(3)
    syllables = ["con", "text", "ual", "ident", "ify", "name", "process", "or", "value", "list", "map", "get", "set"]
    name = lambda k: "".join(rng.choice(syllables) for _ in range(k))
    plain = [(k, " ".join(name(rng.randint(3, 5)) for _ in range(40))) for k in range(60)]
    chars = secrets.ALPHABET[:62]
    token = lambda: "".join(rng.choice(chars) for _ in range(32))
    planted = [(1000 + k, f"here {token()}1 there") for k in range(30)]
    ordinary = [(2000 + k, f"see {name(6)}_{name(3)}2 there") for k in range(30)]
    got = by_id(secrets.secret_scan(docs_of([*plain, *planted, *ordinary])))
    assert sum(len(got[i].spans) == 1 and got[i].spans[0].kind == "random" for i, _ in planted) >= 28
    assert sum(bool(got[i].spans) for i, _ in ordinary + plain) <= 1


def test_personal_base_spans(docs_of):
    rows = [
        *ODD,
        (10, "a@b.c_d@e.f, x@y, é jo.hn+1@ex-ample.co.uk. 1.2.3.4 256.1.1.1 01.002.3.255.9"),
        (11, "4111 1111 1111 1111, 4111-1111-1111-1112 " + "4" * 40),
        (12, "+1 (524) 555-2896 +12 +49.30.1234567 call +1 2 3"),
        (13, "9" * 20_000 + " " + "a" * 20_000 + "@"),
    ]
    found = pii.personal_data(docs_of(rows))
    got = {(r.doc_id, r.s) for r in found.select("doc_id", spans.joined(F.col("base")).alias("s")).collect()}
    assert got == {(i, brute.joined(brute.personal(t))) for i, t in rows}


def test_contexts_find_unseen_identifiers(docs_of):
    rows = [(k, f"please call home number +1 (524) 555-{1000 + k} now") for k in range(40)] + [(k, f"my server address 10.0.{k}.7 is up") for k in range(100, 140)]
    unseen = [(900, "my server address 300.1.2.777 is up"), (901, "in the year 1999.12.31.555 all was well")]
    got = by_id(pii.personal_data(docs_of([*rows, *unseen])))
    assert [x.kind for x in got[900].spans] == ["context_ip"] and not got[900].base
    assert not got[901].spans
    assert all(got[i].spans == got[i].base for i, _ in rows)


def test_contexts_are_learned_from_spaced_numbers(docs_of):
    card = lambda k: next(x for c in range(10) if (x := f"4111 1111 {1000 + k} 111{c}") and brute.personal(x))
    rows = [(k, f"please call home number +1 (524) 555-{1000 + k} now") for k in range(40)] + [(k, f"paid with card {card(k)} today") for k in range(100, 140)]
    rows += [(800, "please call home number +1 (524) 555-1000 or home number +1 (524) 555-1001 now")]
    unseen = [(900, "please call home number (524) 555 1234 now"), (901, "paid with card 4111 1111 1111 1112 today"), (902, "my home number 017 555-7713 and home number 017 555-7714"), (903, "in the years 1999 2000 2001 all was well")]
    got = by_id(pii.personal_data(docs_of([*rows, *unseen])))
    found = {i: [(x.kind, dict(unseen)[i][x.start : x.end]) for x in got[i].spans] for i, _ in unseen}
    assert found == {900: [("context_phone", "(524) 555 1234")], 901: [("context_card", "4111 1111 1111 1112")], 902: [("context_phone", "017 555-7713"), ("context_phone", "017 555-7714")], 903: []}
    assert all(got[i].spans == got[i].base for i, _ in rows)


@pytest.mark.parametrize(("operator", "rule"), [(secrets.secret_scan, brute.secrets), (pii.personal_data, brute.personal)])
def test_spans_of_a_long_text_take_time_in_proportion(docs_of, operator, rule):
    rng = random.Random(4)
    long = " ".join(rng.choice([f"name{k}@host{k % 7}.example.com", f"10.0.{k % 300}.{k % 256}", f"token=abc{k}defg", f"+1 (017) 555-{1000 + k % 9000}", "0f" * 13 + str(k), f"w{k}"]) for k in range(100_000))
    began = time.perf_counter()
    got = operator(docs_of([(1, long), (2, "é" + long[:3000])])).select("doc_id", spans.joined(F.col("base")).alias("s")).collect()
    assert time.perf_counter() - began < 120
    assert {r.doc_id: r.s for r in got} == {1: brute.joined(rule(long)), 2: brute.joined(rule("é" + long[:3000]))}


@pytest.mark.parametrize("operator", [secrets.secret_scan, pii.personal_data])
def test_spans_of_an_empty_table(docs_of, operator):
    assert operator(docs_of([])).count() == 0


# --- 3: quality


def test_quality_base(docs_of):
    again = " ".join(f"t{k}" for k in range(40))
    rows = [*ODD, (10, "a b c d e f g h i j k " * 4), (11, long_text(1)), (12, "same line again and again\n" * 3 + long_text(2)), (13, again + " x " + again + " #*$ |"), (14, " ".join(["run"] * 500))]
    got = rows_of(quality.quality_rules(docs_of(rows)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sorted(((i, *brute.quality(t)) for i, t in rows), key=repr)
    verdict = by_id(quality.quality_rules(docs_of(rows)))
    assert verdict[11].kept and verdict[12].kept and not verdict[10].kept and not verdict[14].kept and not verdict[1].kept
    assert {r.doc_id for r in quality.keep_good(docs_of(rows)).collect()} == {11, 12}


def test_quality_rejects_repeated_lines(docs_of):
    text = "\n".join(["one two three four"] * 30 + [f"w{k} v{k} u{k} t{k}" for k in range(60)])
    got = by_id(quality.quality_rules(docs_of([(1, text)])))
    assert got[1].dup_line_chars == 29 * 15 and not got[1].kept


# --- 4: near duplicates


def near_copies(seed, n, edits, size=120):
    rng = random.Random(seed)
    base = [f"b{seed}x{k}" for k in range(size)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(size)] = f"e{rng.randrange(40)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_match_brute_force(docs_of, k):
    texts = [t for s in range(6) for t in near_copies(s, 12 + 10 * s, 2 + 2 * s)] + [long_text(s, 80) for s in range(20)]
    random.Random(1).shuffle(texts)
    rows = [(n, t) for n, t in enumerate(texts, 100)] + [(1, None), (2, ""), (3, "One two"), (4, "one  two"), (5, "one two three")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs_of(rows), k).collect()}
    want = brute.components(rows, k)
    assert got == want
    kept = neardup.keep_one_of_each(docs_of(rows), k)
    assert kept.columns == docs_of(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_near_duplicates_odd_rows(docs_of):
    got = neardup.near_duplicates(docs_of(ODD), 4).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (None, None, True)}
    assert neardup.near_duplicates(docs_of([]), 4).count() == 0


def test_near_duplicates_of_clashing_and_string_ids(spark, docs_of):
    text = long_text(3, 200)
    rows = [(1, "some other text entirely"), (1, text), (2, text + " more"), (2, text + " more"), (3, text + " more"), (4, None), (4, "some other text entirely"), (None, text)]
    want = sorted([(1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True), (4, 1, False), (None, None, True)], key=repr)
    assert rows_of(neardup.near_duplicates(docs_of(rows), 4), "doc_id", "component_id", "kept") == want
    left = neardup.keep_one_of_each(docs_of(rows).withColumns({"doc": F.lit("x"), "__k1": F.lit("y"), "n": F.lit(0)}), 4)
    assert left.columns[-3:] == ["doc", "__k1", "n"] and rows_of(left, "doc_id", "text") == sorted([rows[0], rows[1], rows[5], rows[7]], key=repr)
    named = spark.createDataFrame([(f"d{i}" if i else None, t) for i, t in rows], "doc_id string, text string")
    assert rows_of(neardup.near_duplicates(named, 4), "doc_id", "component_id", "kept") == sorted([(f"d{i}" if i else None, f"d{c}" if c else None, k) for i, c, k in want], key=repr)


def test_near_duplicates_of_large_groups(docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "SALTED", 4)
    texts = near_copies(1, 90, 22) + near_copies(2, 60, 12) + [long_text(5, 100)] * 300 + [long_text(6, 30_000), long_text(6, 30_000) + " end"]
    rows = list(enumerate(texts))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs_of(rows), 4).collect()} == brute.components(rows, 4)


# --- 6: decontamination


def test_decontamination(spark, docs_of):
    item = long_text(9, 40)
    items = [(1, item), (2, "Short item, five words only"), (3, None), (4, ""), (10, item)]
    w = item.split()
    rows = [*ODD, (10, "x " + ", ".join(w[5:30]).upper() + " y"), (11, " ".join(w[:12])), (12, "say SHORT-item five: words only! " + long_text(4, 50)), (13, long_text(5, 2000) + " " + " ".join(w[3:16]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 50):
        got = rows_of(decontaminate.decontaminate(docs_of(rows), table, block_bytes=block), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert got == sorted(brute.decontaminate(rows, items), key=repr)
        places = {r.doc_id: [text.encode()[a:b].decode() for a, b in r.places] for r in decontaminate.decontaminate(docs_of(rows), table, block_bytes=block).collect() for text in [dict(rows)[r.doc_id] or ""]}
        assert places[10] == [", ".join(w[5:30]).upper()] and places[12] == ["SHORT-item five: words only"] and not places[11]
    left = decontaminate.drop_contaminated(docs_of(rows), table, block_bytes=50)
    assert left.columns == docs_of(rows).columns and {r.doc_id for r in left.collect()} == {1, 2, 3, 4, 5, 6, None, 11, 13}
    assert decontaminate.decontaminate(docs_of(rows), table.limit(0)).where("contaminated").count() == 0


def test_byte_spans():
    text = "é, Foo-bar baz".encode()
    assert [text[a:b].decode() for a, b in decontaminate.byte_spans(text, [(0, 1), (1, 3)])] == ["é", "Foo-bar"]


# --- 7: pages


def page(host, k, body, nav="Home", tail="</body></html>"):
    return (k, f"http://{host}/p{k}", f"<html><head><title>T{k}</title><style>p{{}}</style></head><body><nav><ul><li>{nav}{k}</li></ul></nav><div class='site'>{body}</div><footer>same</footer>{tail}")


def test_html_blocks_and_noise(spark):
    body = "<article><header><h1>Title &amp; more</h1></header><p>One&nbsp;two<br>three<p><b>bold</b> x<!-- no --><div class='ad'>buy</div><script>var p='</p>';</script><ul><li>a<li>b</ul><section id='comments'><p>reader</p></section><form>f</form></article>"
    rows = [page("a.example", 1, body), (2, None, None), (3, "x", ""), (4, "http://b.example/", "plain &lt;text&gt; é <p>q")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Title & more\nOne two three\nbold x\na\nb", 2: "", 3: "", 4: "plain <text> é\nq"}


def test_wrapper_is_induced_without_article(spark):
    rows = [page("c.example", k, f"<div class='top'><p>Welcome to our site</p></div><div class='text'><h2>Head {k}</h2><p>{long_text(k, 30 + k)}</p><div class='legal'>All the same words</div></div>", nav="x") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rule = html.wrappers(pages).collect()
    path = 0
    for key in ("html", "body", "div.site", "div.text"):
        path = html.path_of(path, key)
    assert [r.root for r in rule] == [path]
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got == {k: f"Head {k}\n{long_text(k, 30 + k)}" for k in range(60)}


def extracted(spark, rows):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("n", [1, 5, 60])
def test_wrapper_keeps_what_stands_beside_the_body(spark, n):
    words = lambda k: long_text(k, 60)
    article = lambda k: f"<article><h1>Title {k}</h1><p>Lead {k}</p><div class='body'><p>{words(k)}</p></div></article>"
    sections = lambda k: f"<article><h2>First {k}</h2><section><p>{words(k)}</p></section><h2>Second {k}</h2><section><p>{k} end</p></section></article>"
    got = extracted(spark, [page("d.example", k, article(k)) for k in range(n)] + [page("e.example", 100 + k, sections(k)) for k in range(n)])
    assert got == {k: f"Title {k}\nLead {k}\n{words(k)}" for k in range(n)} | {100 + k: f"First {k}\n{words(k)}\nSecond {k}\n{k} end" for k in range(n)}


def test_wrapper_without_article_holds_all_that_varies(spark):
    rows = [page("f.example", k, f"<div class='top'>Welcome</div><div class='head'><h1>Title {k}</h1></div><div class='text'><p>{long_text(k, 90)}</p></div>") for k in range(20)]
    assert extracted(spark, rows) == {k: f"Title {k}\n{long_text(k, 90)}" for k in range(20)}


def test_template_is_dropped_only_where_its_text_stands(spark):
    box = lambda k: "Corrected on page 7" if k == 7 else "All the same words"
    rows = [page("g.example", k, f"<article><h1>Head {k}</h1><div class='box'>{box(k)}</div><p>{long_text(k, 40)}</p></article>") for k in range(40)]
    assert extracted(spark, rows) == {k: f"Head {k}\n" + (box(k) + "\n" if k == 7 else "") + long_text(k, 40) for k in range(40)}


def test_copies_of_one_page_make_no_template(spark):
    half = lambda k, at: long_text(2 * min(k, 4) + at, 50)
    rows = [page("h.example", k, f"<article><h1>One head</h1><div class='a'><p>{half(k, 0)}</p></div><div class='b'><p>{half(k, 1)}</p></div></article>") for k in range(160)]
    assert extracted(spark, rows) == {k: f"One head\n{half(k, 0)}\n{half(k, 1)}" for k in range(160)}


@pytest.mark.parametrize("wrap", ["<div class='content-sidebar-wrap'>", "<div class='has-sidebar'>", "<div class='menu-open'>", "<form id='aspnetForm'>", "<div id='menu'>", "<form class='menu'>"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_wrappers_named_like_noise_are_kept(wrap, inner):
    body = f"{wrap}<{inner}><h2 id='related-work'>Work</h2><section id='notice-of-change'><p>{long_text(1, 30)}</p></section><div class='cookie-notice'>eat</div></{inner}></{wrap[1:5].strip()}>"
    root = html.parse(page("i.example", 1, body)[2])
    assert html.main_text(root, None, []) == "Work\n" + long_text(1, 30)
    assert [x.noise for x in html.skeleton(root) if x.key == "section.notice-of-change"] == [False]


def test_simple_tree_matching(monkeypatch):
    tree = lambda body: html.skeleton(html.parse(f"<body>{body}</body>"))
    a = tree("<h1>x</h1><nav>1</nav><div class=x><ul>a</ul></div><nav>2</nav>")
    b = tree("<h1>y</h1><div class=x><ul>b</ul></div><nav>2</nav><table>t</table>")
    keys = lambda: [(a[i].key, b[j].key) for i, j in html.tree_match(a, b)]
    assert keys() == [(k, k) for k in ("#", "body", "div.x", "nav", "ul")]
    varies = {a[p].key: n for p, n in html.aligned(a, b)}
    assert varies == {"#": 3, "body": 3, "div.x": 1, "ul": 1, "nav": 0}  # the heading, the table and the list; the menu on one side is noise
    monkeypatch.setattr(html, "CELLS", 1)
    assert {x for x, _ in keys()} == {"#", "body", "div.x", "nav", "ul"}


@pytest.mark.parametrize("wrapper", [True, False])
def test_deeply_nested_and_long_pages(spark, wrapper):
    deep = "<div>" * 10_000 + "<p>deep text</p>" + "</b></div>" * 9_000
    long = "".join(f"<h2>Head {k}</h2><div><p>part {k}</p></div>" for k in range(3000))
    rows = [page("deep.example", 1, deep), page("deep.example", 2, f"<article>{long}</article>")]
    rows += [page("deep.example", 3 + k, f"<article><p>{long_text(k, 30)}</p></article>") for k in range(8 * wrapper)]
    got = extracted(spark, rows)
    assert got[1] == "deep text" and got[2] == "\n".join(f"Head {k}\npart {k}" for k in range(3000))
    assert all(got[3 + k] == long_text(k, 30) for k in range(8 * wrapper))


def test_hosts_template_is_learned_whatever_its_tags(spark, monkeypatch):
    monkeypatch.setattr(html, "NOISE_WORDS", frozenset())
    rows = [page("j.example", k, f"<div class='q'><div class='links'>One two three</div><h1>Head {k}</h1><p>{long_text(k, 40)}</p><div class='end'>All the same words</div></div>") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [len(r.template) for r in html.wrappers(pages).collect()] == [3]  # links, end and the footer
    assert extracted(spark, rows) == {k: f"Head {k}\n{long_text(k, 40)}" for k in range(40)}


def test_extract_of_an_empty_table_and_extra_columns(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(none).collect() == []
    more = spark.createDataFrame([(1, "http://a.example/", "<p>x", "kept", "old", "h")], "page_id long, url string, html string, __root string, text string, host string")
    assert [tuple(r) for r in html.extract(more).select("page_id", "__root", "text", "host").collect()] == [(1, "kept", "x", "h")]


# --- 8: substrings


def test_substring_dedup(docs_of):
    shared = long_text(77, 60).split()
    once = long_text(78, 40)
    rows = [*ODD, (10, long_text(1, 50) + " " + " ".join(shared) + " " + long_text(2, 50)), (11, " ".join(shared[10:50])), (12, once + " x " + once), (13, " ".join(shared[:34])), (14, long_text(5)), (15, long_text(5)), (16, long_text(5).replace(" ", "  ", 1)), (17, "the " * 120), (18, long_text(6, 3000) + " " + " ".join(shared[20:56]))]
    rows += [(100 + k, f"{long_text(200 + k, 20)} {' '.join(shared[k : k + 50])} {long_text(300 + k, 20)}") for k in range(10)]
    for hot in (substrings.HOT_TEXTS, 2):  # without and with a reference of frequent passages
        got = rows_of(substrings.repeated_words(docs_of(rows), hot_texts=hot), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == sorted(brute.substrings(rows), key=repr)
    assert substrings.repeated_words(docs_of([])).count() == 0


def test_suffix_automaton_matching_statistics():
    rng = random.Random(5)
    for _ in range(30):
        texts = [[bytes([97 + rng.randrange(3)]) for _ in range(rng.randrange(1, 25))] for _ in range(3)]
        query = [bytes([97 + rng.randrange(4)]) for _ in range(40)]
        known = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
        want = [max((n for n in range(k + 2) if tuple(query[k + 1 - n : k + 1]) in known), default=0) for k in range(len(query))]
        assert substrings.SuffixAutomaton(texts).matches(query) == want


def test_known_passages_are_removed(spark, docs_of):
    known = long_text(50, 100)
    reference = spark.createDataFrame([(known,), (None,), (long_text(51, 20),)], "text string")
    w = known.split()
    rows = [(1, None), (2, "x " + " ".join(w[20:70]) + " y"), (3, " ".join(w[:34])), (4, long_text(52))]
    for shard in (substrings.SHARD_WORDS, 45):
        got = {r.doc_id: r.text for r in substrings.remove_known(docs_of(rows), reference, shard_words=shard).collect()}
        assert got == {1: None, 2: "x y", 3: rows[2][1], 4: rows[3][1]}


# --- 9: mixing


def test_mixing(docs_of):
    rng = random.Random(2)
    rows = [(k, long_text(k, rng.randint(1, 60)), rng.choice(["b", "a", "Z", None, "é"])) for k in range(900)] + [(5000, None, "a"), (5001, " ", "a"), (5002, "one two", None), (5002, "one two", None)]
    docs = docs_of(rows)
    got = mixing.mix(docs, block=16).collect()
    size = {i: len(brute.SPACED.findall(t or "")) for i, t, _ in rows}
    total = {}
    for i, _, s in rows:
        total[s] = total.get(s, 0) + size[i]
    want, source, taken = brute.targets(total), {i: s for i, _, s in rows}, {}
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r["source_size"] == total[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1.5 for s in want)
    parts = {s: sum(r["taken"] % max(r["size"], 1) > 0 for r in got if source[r.doc_id] == s) for s in want}
    assert all(n <= 1 for n in parts.values())
    assert {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(7), block=16).collect()} == {(r["doc_id"], r["taken"]) for r in got}
    left = mixing.mixed_rows(docs)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "size", "source_size", "target", "taken"]
    assert mixing.mix(docs_of([])).count() == 0


def test_mixing_of_one_id_and_text_in_several_sources(docs_of):
    texts = [long_text(k, 10 + k) for k in range(4)]
    rows = [(k, texts[k], s) for k in range(4) for s in ("x", "y", None)] + [(7, "a b c", "x"), (7, "a b c", "x"), (7, "d e", "x")]
    got = mixing.mix(docs_of(rows)).collect()
    assert sorted((r.doc_id, r["__source"] or "", r["size"]) for r in got) == sorted((i, s or "", len(t.split())) for i, t, s in rows)
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r["__source"]] = taken.get(r["__source"], 0) + r.taken
    want = brute.targets({s: sum(len(t.split()) for _, t, z in rows if z == s) for s in ("x", "y", None)})
    assert all(abs(taken[s] - want[s]) <= 1.5 for s in want)
    left = mixing.mixed_rows(docs_of(rows).withColumns({"s": F.lit(1), "key": F.lit(2), "__key": F.lit(3), "row": F.lit(4)}))
    assert sorted((r.doc_id, r.source or "", r.taken) for r in left.collect()) == sorted((r.doc_id, r["__source"] or "", r.taken) for r in got if r.taken)
    assert left.columns[-8:-4] == ["s", "key", "__key", "row"]


def test_mixing_draws_each_document_with_its_probability(docs_of):
    rows = [(k, f"x{k} " * 10, s) for k in range(2000) for s in ["a" if k < 1200 else "b"]]
    got = mixing.mix(docs_of(rows)).collect()
    share = [r["taken"] / 10 for r in got if r.doc_id < 1200]
    assert abs(sum(share) / 1200 - got[0]["target"] / got[0]["source_size"]) < 1e-3 if got[0].doc_id < 1200 else True
    halves = [sum(share[:600]) / 600, sum(share[600:]) / 600]
    assert abs(halves[0] - halves[1]) < 0.12


# --- 10: lines


def test_line_dedup(docs_of):
    rows = [(k, f"  Subscribe to our list \nown line number {k}\nshort\nonly on nine sites {min(k % 12, 8)}", f"s{k % 12}") for k in range(60)]
    rows += [(100 + k, f"nine sites carry this line\nx{k}", f"s{k % 9}") for k in range(30)] + [(200, None, "s1"), (201, "", None), (202, "Subscribe to our list", None), (203, "Subscribe to our list", None), (203, "Subscribe to our list", None)]
    got = rows_of(lines.line_report(docs_of(rows)).withColumn("sha", F.sha2("clean_text", 256)), "doc_id", "n_lines", "n_removed", "sha")
    assert got == sorted(brute.lines(rows), key=repr)
    clashing = docs_of(rows).withColumns({c: F.lit("mine") for c in ("__k1", "__gone", "id", "site", "others")})
    kept = lines.remove_boilerplate(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(rows) and kept.where("__k1 = 'mine' and others = 'mine'").count() == len(rows)
    assert by_id(kept)[200].text is None and by_id(kept)[0].text.startswith("  Subscribe")
    assert lines.line_report(docs_of([])).count() == 0


def test_many_lines_of_one_text(docs_of):
    many = "\n".join(f"a line that many sites carry {k % 4000}" if k % 3 else f"own line of this text {k}" for k in range(30_000))
    rows = [(0, many, "s0")] + [(1 + j, "\n".join(f"a line that many sites carry {k}" for k in range(4000)), f"s{1 + j}") for j in range(10)]
    got = rows_of(lines.line_report(docs_of(rows)).withColumn("sha", F.sha2("clean_text", 256)), "doc_id", "n_lines", "n_removed", "sha")
    assert got == sorted(brute.lines(rows), key=repr)


def test_near_threshold_sites_are_counted_exactly(docs_of):
    rows = [(k, f"a line on {n} sites indeed\nz{k}", f"s{j}") for n in range(5, 16) for j in range(n) for k in [100 * n + j]]
    got = by_id(lines.line_report(docs_of(rows)))
    assert {n for n in range(5, 16) if got[100 * n + 1].n_removed} == set(range(10, 16))


# --- the registered queries


def test_queries_match_their_sql(spark, sf_dir):
    import duckdb

    from framecut.llm.oracle import ORACLES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name, sql in ORACLES.items():
        found = queries.QUERIES[name](spark, sf_dir)
        want = con.sql(sql)
        assert sorted(found.columns) == sorted(want.columns), name
        assert rows_of(found, *want.columns) == sorted(want.fetchall(), key=repr), name


def test_span_queries_match_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for name, rule in (("op2_secret_scan", brute.secrets), ("op5_pii", brute.personal)):
        got = {r.doc_id: r for r in queries.QUERIES[name](spark, sf_dir).collect()}
        assert {i: r.base_sha256 for i, r in got.items()} == {i: brute.sha(brute.joined(rule(t))) for i, t in rows}


def test_page_query_matches_articles(spark, sf_dir):
    import html as std
    import re

    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.QUERIES["op7_html_extraction"](spark, sf_dir).collect()}
    for r in rows:
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", std.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split("</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url
