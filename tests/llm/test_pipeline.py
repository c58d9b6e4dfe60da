import random

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from framecut.llm import quality


def text(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(9000)}" for _ in range(n))


def test_stages_do_their_work(spark, docs_of, tmp_path):
    item = text(1, 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    copies = text(2, 200)
    rows = [(k, text(100 + k, 60) + "\nA line of boilerplate here", f"s{k % 12}") for k in range(60)]
    rows += [(500, copies, "s1"), (501, copies, "s2"), (502, copies.replace("w", "v", 1), "s3"), (600, "junk " * 80, "s1"), (601, item + " and more", "s2"), (602, None, "s3"), (603, "", None)]
    docs = docs_of(rows, extra=False)
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)))
        seen[name] = {r.doc_id for r in docs.collect()}
        if name != "source mixing":
            assert docs.columns == columns
    clean = set(range(60))
    assert seen["quality rules"] == clean | {500, 501, 502, 601}
    assert seen["line dedup"] == seen["quality rules"]
    assert seen["near dedup"] == clean | {500, 601}
    assert seen["decontamination"] == clean | {500}
    assert seen["source mixing"] <= seen["decontamination"]
    assert docs.where(F.col("taken") > 2 * F.col("size")).count() == 0
    per = docs.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 1.5 for r in per)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "source mixing"]


def test_run_over_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}  # its SQL checks the rules
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in good)
    assert len(rows) > 100
    rows = [(i, "\n".join(left), s) for (i, _, s), left in zip(rows, brute.lines_left(rows), strict=True)]
    alone = {i for i, (_, c) in brute.components([(i, t) for i, t, _ in rows], 5).items() if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [r for r in rows if r[0] in alone]
    dirty = {x[0] for x in brute.decontaminate([(i, t) for i, t, _ in rows], items) if x[-1]}
    rows = [r for r in rows if r[0] not in dirty]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    want = {i: (t, s) for i, t, s in rows}
    assert all(want[r.doc_id] == (r.text, r.source) and 0 < r.taken <= 2 * r["size"] for r in got) and len({r.doc_id for r in got}) == len(got)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.SPACED.findall(t))
    for s, target in brute.targets(sizes).items():
        assert abs(sum(r.taken for r in got if r.source == s) - target) <= 1.5 and all(abs(r.target - target) < 1e-6 for r in got if r.source == s)


def test_stages_of_an_empty_table(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0
