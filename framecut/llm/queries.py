"""The fixed-contract queries of the text operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, filteraudit, html, licenses, lines, mixing, neardup, pii, quality, secrets, simhash, spans, substrings, vectorcodes


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span_digest(found, kinds):
    base = F.col("base")
    return found.select("doc_id", *(spans.count_of(base, k).alias(f"n_{k}") for k in kinds), spans.digest(base).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"))


def op1_license_scan(spark, sf_dir):
    """Identifier tags and notice phrases of every document."""
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("expressions")


def op2_secret_scan(spark, sf_dir):
    """Base spans and random-looking tokens of every document."""
    found = secrets.secret_scan(table(spark, sf_dir, "documents"))
    return span_digest(found, secrets.KINDS)


def op3_quality_rules(spark, sf_dir):
    """Repetition measures and verdict of every document."""
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark, sf_dir):
    """Component of every document over links of similarity 0.8 on 4-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op5_pii(spark, sf_dir):
    """Base spans and spans found by learned contexts in every document."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return span_digest(found, pii.KINDS)


def op6_decontaminate(spark, sf_dir):
    """Words of every document that stand in a window of a benchmark item."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("places")


def op7_html_extraction(spark, sf_dir):
    """Main text of every page."""
    text = F.col("text")
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length(text).cast("long").alias("n_chars"))


def op8_substring_dedup(spark, sf_dir):
    """What is left of every document without passages that stand elsewhere too."""
    return substrings.repeated_words(table(spark, sf_dir, "documents")).drop("spans")


def op9_source_mixing(spark, sf_dir):
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_line_dedup(spark, sf_dir):
    """Lines of every document, those removed as cross-site boilerplate, and a digest of what is left."""
    return lines.line_report(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("clean_text", 256).alias("kept_sha256"))


def op11_vector_codes(spark, sf_dir):
    """Part codes of every vector by codebooks learnt from all of them, with errors by row and by label."""
    codes, books = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    found = vectorcodes.label_errors(codes)
    return found.select("vec_id", "code", "error", "label_error", F.lit(vectorcodes.codebooks_digest(books)).alias("codebooks_sha256"))


def op12_filter_audit(spark, sf_dir):
    """What each order of the five filters keeps and removes of every part of the documents."""
    return filteraudit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_simhash_dedup(spark, sf_dir):
    """Fingerprint and component of every document over links of four differing bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), k=4)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_secret_scan, op3_quality_rules, op4_near_dedup, op5_pii, op6_decontaminate, op7_html_extraction, op8_substring_dedup, op9_source_mixing, op10_line_dedup, op11_vector_codes, op12_filter_audit, op13_simhash_dedup)}
