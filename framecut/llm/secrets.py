"""Secret scans: format rules, and character Markov models of random strings and identifiers.

In DataFrame functions only.  The format rules give the base spans.  Two first-order character
models, one of random strings and one of ordinary identifiers, are compared by log-likelihood
ratio; a long token outside the base spans whose ratio is high enough is a ``random`` span.

Both models are trained here from labelled samples: the values that the format rules found and
generated digests on one side, identifiers outside them on the other, at most ``sample`` of each
(those of smallest hash, so reruns agree).  The model is a table of at most len(ALPHABET)^2 cells.

Defined results: a null or empty text has no span; a text of any length is read whole, in time that
grows with it; repeated rows give repeated results; spans of one start are ordered by kind; without
any labelled value the generated digests alone stand for secrets; without identifiers the ratio
is that of smoothing alone; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .spans import SPAN, bound, find_spans, in_blocks, ordered, outside

# The base patterns.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Tokens of 20 or more characters with a digit; the look-behind keeps the search linear.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
#: The label "ordinary": words of letters and underscores, with at most three digits at the end.
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z_]{8,40}+[0-9]{0,3}+(?![A-Za-z0-9+/_=-])"
KINDS = ("assign", "access", "hex")
#: Labelled rows of each side, at most; identifiers that one text adds to the candidates for the sample.
SAMPLE, PER_TEXT, GENERATED = 20_000, 4, 2_000
#: Mean log-likelihood ratio for each character pair, and its sum, from which a token counts as random.
MEAN_RATIO, SUM_RATIO, SMOOTHING, BACK_OFF = 0.7, 20.0, 0.5, 8.0


def base_spans(text: Column) -> Column:
    """Spans of the three format rules; an assign span's txt is the value."""
    value = lambda x: F.regexp_extract(x, ASSIGN, 2)
    named = bound(F.lower(text), lambda t: F.contains(t, F.lit("pass")) | F.contains(t, F.lit("secret")) | F.contains(t, F.lit("token")) | F.contains(t, F.lit("api")))
    return F.concat(
        find_spans(text, ASSIGN, "assign", 0, lambda x: F.length(value(x)) >= 6, needs=named),
        find_spans(text, ACCESS, "access", 1, needs=F.contains(text, F.lit("AKIA"))),
        find_spans(text, HEX, "hex", 2, needs=text.rlike(HEX)),
    )


def code(c: Column) -> Column:
    """Number of a character in ALPHABET, -1 if it isn't there."""
    return F.call_function("locate", c, F.lit(ALPHABET)) - 1


def train(scanned: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratio of each pair of characters of ALPHABET, row by row."""
    spark = scanned.sparkSession
    known = scanned.select(F.explode("base").alias("x")).select(F.when(F.col("x.kind") == "assign", F.regexp_extract("x.txt", ASSIGN, 2)).otherwise(F.col("x.txt")).alias("t"))
    few = lambda df: df.where("length(t) > 1").distinct().orderBy(F.xxhash64("t"), "t").limit(sample)
    made = spark.range(GENERATED).select(F.explode(F.array(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 512))), F.md5(F.col("id").cast("string")), F.left(F.upper(F.md5(F.col("id").cast("string"))), F.lit(20)))).alias("t"))
    plain = scanned.select(F.explode("words").alias("t"))
    pairs = few(known).union(made).select("t", F.lit(True).alias("random")).union(few(plain).select("t", F.lit(False)))
    codes = F.transform(F.split("t", ""), code)
    counted = (
        pairs.select("random", codes.alias("c"))
        .select("random", F.explode(F.arrays_zip(F.col("c").alias("a"), F.expr("slice(c, 2, size(c))").alias("b"))).alias("x"))
        .where("x.a >= 0 and x.b >= 0")
        .groupBy("random", "x.a", "x.b")
        .agg(F.count("*").alias("n"))
        .collect()  # at most 2 * len(ALPHABET)^2 rows
    )
    size = len(ALPHABET)
    n: dict = defaultdict(float)
    for r in counted:
        n[r["random"], r["a"], r["b"]] += r["n"]
        n[r["random"], r["a"]] += r["n"]
        n[r["random"], -1, r["b"]] += r["n"]
        n[r["random"],] += r["n"]

    def p(side: bool, a: int, b: int) -> float:
        """Log-probability of b after a, backed off to that of b."""
        alone = (n[side, -1, b] + SMOOTHING) / (n[side,] + SMOOTHING * size)
        return math.log((n[side, a, b] + BACK_OFF * alone) / (n[side, a] + BACK_OFF))

    return [p(True, a, b) - p(False, a, b) for a in range(size) for b in range(size)]


def ratio(token: Column, model: list[float]) -> Column:
    """Sum of the model's ratios over the pairs of characters of a token."""
    size = len(ALPHABET)
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in model)), ",").cast("array<double>")
    def step(a, c):
        pair = F.when((a["prev"] >= 0) & (code(c) >= 0), F.get(table, a["prev"] * size + code(c))).otherwise(0.0)
        return F.struct(code(c).alias("prev"), (a["sum"] + pair).alias("sum"))

    return F.aggregate(F.split(token, ""), F.struct(F.lit(-1).alias("prev"), F.lit(0.0).alias("sum")), step, lambda a: a["sum"])


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """id_col, base and spans (base and random ones), sorted, for each row of docs.  One pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = cut(
        docs.select(
            F.col(id_col),
            base_spans(text).alias("base"),
            find_spans(text, TOKEN, "random", len(KINDS), needs=text.rlike(TOKEN)).alias("tokens"),
            F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))), 1, PER_TEXT).alias("words"),
        )
    )
    model = train(scanned, sample)
    token_ratio = lambda x: ratio(x["txt"], model)
    random = F.filter(bound(in_blocks(F.col("base")), lambda blocks: outside(F.col("tokens"), blocks)), lambda x: token_ratio(x) >= F.greatest(F.lit(SUM_RATIO), MEAN_RATIO * (F.length(x["txt"]) - 1)))
    return scanned.select(id_col, "base", F.coalesce(random, F.array().cast(SPAN)).alias("random")).select(id_col, ordered(F.col("base")).alias("base"), ordered(F.col("base"), F.col("random")).alias("spans"))
