"""The corpus pipeline: five stages over documents, each written and read again before the next."""

from __future__ import annotations

from framecut.llm import decontaminate, lines, mixing, neardup, quality
from framecut.llm.common import cut


def quality_rules(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def line_dedup(spark, docs, sf_dir):
    """Cross-site boilerplate lines go; documents stay."""
    return lines.remove_boilerplate(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays (five-word shingles, similarity 0.8)."""
    return neardup.keep_one_of_each(docs, k=5)


def decontamination(spark, docs, sf_dir):
    """Documents contaminated by benchmark items go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark, docs, sf_dir):
    """Documents that the mix takes, with the words taken."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("source mixing", source_mixing),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs


#: The last stage draws at random from hashes, which DuckDB doesn't have: tested by brute force.
ORACLE_SQL = None
