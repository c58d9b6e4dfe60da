"""Short and hot lines, and parts of pages that class words name."""

import brute
import pytest
from pyspark.sql import functions as F

from framecut.llm import common, html, lines, substrings


def sums(df):
    found = df.withColumn("sha", F.sha2("clean_text", 256)).select("doc_id", "n_lines", "n_removed", "sha")
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_short_and_hot_lines(docs_of, monkeypatch):
    """One line holds over a third of all occurrences, more lines than are broadcast are frequent, and short ones count."""
    monkeypatch.setattr(common, "HEAVY", 3)
    rows = [(k, "\n".join(["Read more", "}", "Les."][: 1 + k % 3] * 2 + [f"own {k}", f"frequent {k % 7}", f"ten {k % 5}"]), f"s{k % 30}") for k in range(300)]
    assert sums(lines.line_report(docs_of(rows))) == sorted(brute.lines(rows), key=repr)
    left = {r.doc_id: r.clean_text for r in lines.line_report(docs_of(rows)).collect()}
    assert left[0].startswith("Read more\nown 0") and left[30].split("\n")[0] == "own 30"


def page(k, extra, tail=""):
    words = " ".join(f"w{k}x{j}" for j in range(60))
    return f"<html><body><div id='nav-bar'><a href='/'>Home</a></div><div class='story'><h1>Title {k}</h1><p>{words}</p></div>{extra.format(k=k)}<div class='footer-links'>Imprint</div>{tail}</body></html>", f"Title {k}\n{words}"


@pytest.mark.parametrize("part", ["<div class='comment-list'><p>Reader {k} says hello {k}</p></div>", "<div class='related-posts'><a href='/{k}'>Another story {k}</a></div>", "<div class='ad-slot'>Buy thing {k} now</div>", "<ul id='comments_area'><li>me {k} too</li></ul>"])
@pytest.mark.parametrize("pages", [1, 3, 30])
def test_named_parts_go_on_hosts_of_any_size(spark, part, pages):
    made = [page(k, part) for k in range(pages)]
    df = spark.createDataFrame([(k, f"https://h.example/{k}", h) for k, (h, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got == {k: text for k, (_, text) in enumerate(made)}


@pytest.mark.parametrize("name", ["related-work", "content-sidebar-wrap", "has-sidebar", "no-menu", "notice-of-motion", "main-menu-open"])
def test_other_names_are_content(name):
    assert not html.names_noise(name)


def test_known_passages_leave_every_column(docs_of):
    passage = " ".join(f"k{j}" for j in range(40))
    df = docs_of([(1, f"a {passage} b"), (2, None)]).withColumns({"__known": F.lit("mine"), "__known_": F.lit(2)})
    found = substrings.remove_known(df, docs_of([(9, passage)]))
    assert found.columns == df.columns and {(r.doc_id, r.text, r["__known"], r["__known_"]) for r in found.collect()} == {(1, "a b", "mine", 2), (2, None, "mine", 2)}
