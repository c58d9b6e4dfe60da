"""Personal data: format rules, and contexts learned from them that find unseen identifiers.

In DataFrame functions only.  The format rules give the base spans, which are the seeds.  Base spans,
other tokens with a digit or @, and runs of numbers with spaces or brackets inside are the
instances, the two words before an instance its pattern.  Patterns and
instances form a graph; each round scores a pattern for a kind by the mean score of its
instances, and an unseen instance by its confident patterns (noisy or).  After ROUNDS rounds the
confident patterns mark unseen instances of a fitting form as ``context_<kind>`` spans.

The graph's edges are aggregated before they meet: a pattern or instance as common as a third of
all rows is one count.

Defined results: a null or empty text has no span; a text of any length is read whole, in time that
grows with it; failing matches are dropped without retries; repeated rows give repeated results but
count as one instance; an instance that fits several kinds gets a span of each, ordered by kind;
without seeds nothing is learned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .spans import SPAN, bound, find_spans, in_blocks, ordered, outside, overlapping

# The base patterns, with possessive repeats where nothing that follows could need less.
_LOCAL = r"A-Za-z0-9._%+-"
#: A match starts with its run of local characters, or where the last match ended within the run.
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

KINDS = ("email", "ip", "card", "phone")
#: An unseen instance: a run of these characters with a digit or @.
TOKEN = r"(?<![A-Za-z0-9._%+@:/-])[A-Za-z._%+:/-]*+[0-9@][A-Za-z0-9._%+@:/-]*+"
#: Another: numbers with spaces, brackets, dots or dashes between, of RUN_DIGITS in all.
RUN = r"(?<![A-Za-z0-9._%+@:/-])[+(]{0,2}+[0-9]++(?![A-Za-z_%@:/])(?:[\x20().-]{1,3}+[0-9]++(?![A-Za-z_%@:/]))++"
RUN_DIGITS = (6, 19)
ROUNDS = 3
#: Seeds that a pattern needs, its least confidence, and the score from which an instance is found.
MIN_SEEDS, CONFIDENT, FOUND = 5, 0.9, 0.9


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = F.transform(F.split(F.reverse(number), ""), lambda c, i: c.cast("int") * (i % 2 + 1))
    total = F.aggregate(value, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    part = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    size = lambda x: F.length(digits(x))
    find = partial(find_spans, text, context=True)
    return F.concat(
        find(EMAIL, "email", 0, needs=F.contains(text, F.lit("@"))),
        find(IP, "ip", 1, lambda x: x.rlike(rf"^{part}(?:\.{part}){{3}}$"), needs=text.rlike(r"[0-9]\.[0-9]")),
        find(CARD, "card", 2, lambda x: F.when(size(x).between(14, 19), luhn(digits(x))).otherwise(False), needs=text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]")),
        find(PHONE, "phone", 3, lambda x: size(x).between(10, 15), needs=F.contains(text, F.lit("+"))),
    )


def fits(txt: Column, kind: Column) -> Column:
    """Whether an instance has the form that a kind needs at least."""
    return F.when(kind == "email", F.contains(txt, F.lit("@"))).otherwise((F.length(digits(txt)) >= 6) & ((kind != "ip") | ~txt.rlike(r"[\x20()]")))


def learn(tokens: DataFrame) -> DataFrame:
    """pattern, kind, confidence of the confident patterns; tokens has pattern, txt and kind (null if unseen)."""
    edges = cut(tokens.where("pattern <> ''").groupBy("pattern", "txt").agg(F.max("kind").alias("kind")))
    width = edges.groupBy("pattern").agg(F.count("*").alias("width"))
    seeds = edges.where("kind is not null").select("pattern", "txt", "kind", F.lit(1.0).alias("score"))
    scored = seeds
    for round_ in range(ROUNDS):
        sums = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count("*").alias("c"))
        patterns = sums.where(F.col("c") >= MIN_SEEDS).join(width, "pattern").withColumn("confidence", F.col("s") / F.col("width")).where(F.col("confidence") >= CONFIDENT).select("pattern", "kind", "confidence")
        patterns = cut(patterns)
        if round_ < ROUNDS - 1:
            unseen = edges.where("kind is null").select("pattern", "txt").join(patterns, "pattern").where(fits(F.col("txt"), F.col("kind")))
            found = unseen.groupBy("txt", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("score"))
            spread = edges.where("kind is null").select("pattern", "txt").join(found, "txt")
            scored = seeds.union(spread.select("pattern", "txt", "kind", "score"))
    return patterns


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base and spans (base and learned ones), sorted, for each row of docs.  One pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    token = find_spans(text, TOKEN, "token", 9, lambda x: F.length(x) >= 6, context=True, needs=text.rlike("[0-9@]"))
    run = find_spans(text, RUN, "run", 9, lambda x: x.rlike(r"[\x20()]") & F.length(digits(x)).between(*RUN_DIGITS), context=True, needs=text.rlike(r"[0-9][\x20().-]"))
    scanned = cut(docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col), base_spans(text).alias("base"), token.alias("tokens"), run.alias("runs")))
    words = F.regexp_extract(F.lower(F.regexp_replace("t.left", "[0-9]", "0")), r"(\S+\s+\S+)\s+[^\s\w]*$", 1)

    def instances(blocks):
        # A token that starts in a base span is that span's part; one that starts before is seen with its kind.
        others = F.filter("tokens", lambda t: ~F.exists(overlapping(t, blocks), lambda b: b["start"] <= t["start"]))
        seen = F.transform(others, lambda t: t.withField("kind", F.coalesce(F.get(overlapping(t, blocks), F.lit(0))["kind"], t["kind"])))
        return F.concat(F.col("base"), seen, outside(F.col("runs"), blocks))

    tokens = scanned.select("__row", F.explode(bound(in_blocks(F.col("base")), instances)).alias("t")).select("__row", F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.col("t.txt").alias("txt"), F.regexp_replace(words, r"\s+", " ").alias("pattern"), F.when(F.col("t.kind").isin(*KINDS), F.col("t.kind")).alias("kind"))
    tokens = cut(tokens)
    patterns = learn(tokens)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("k")).cast("int") + (len(KINDS) - 1)
    hits = tokens.where("kind is null").join(patterns.withColumnRenamed("kind", "k"), "pattern").where(fits(F.col("txt"), F.col("k")) & (F.col("confidence") >= FOUND))
    span = F.struct(F.col("start"), rank.alias("rank"), F.col("end"), F.concat(F.lit("context_"), "k").alias("kind"), "txt", F.lit("").alias("left"))
    found = hits.groupBy("__row").agg(F.collect_list(span).cast(SPAN).alias("found"))
    return scanned.join(found, "__row", "left").select(id_col, ordered(F.col("base")).alias("base"), ordered(F.col("base"), F.coalesce("found", F.array().cast(SPAN))).alias("spans"))
