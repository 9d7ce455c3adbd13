"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Every document gets a pseudo-random key (MD5 of its id).  Within its source, documents stand in key
order; since such keys are uniform, ranges of the key's leading digits are even ranges of documents, so
the order is dealt out over ``source x range`` buckets without sampling and a source with a third of all
rows spreads over all tasks.  Prefix sums are taken inside buckets, then over the bucket totals (at most
``RANGES`` a source), and both are added up.  A source's budget is then cut exactly: whole epochs first,
then documents in key order, the last one in part.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source of its own, last
in order; a null doc_id gets the key of the empty string; repeated rows tie and are ordered by doc_id and
size, so equal rows share one fate up to which of them is cut.  An empty table gives an empty table.
Columns besides those named here pass through ``mix`` unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialized, table, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
#: Key ranges: the first three hexadecimal digits of the key.
RANGE_DIGITS = 3
SEED = "mix-1"


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size)`` -> also ``target``: weighted shares, capped at ``max_epochs`` x size.

    Resharing the excess by weight until no source is above its cap ends where each source has
    ``min(cap, level * weight)``.  Sources sorted by ``cap / weight`` fill up one after the other, so the
    level comes from prefix sums.  One row a source is all that meets in a window here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (n % len(weights) + 1).cast("int"))
    t = totals.withColumn("rank", n).withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (
        t.withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights_onward", F.sum("weight").over(onward))
        .withColumn("wanted", F.sum("source_size").over(everything).cast("double") * F.lit(float(share)))
    )
    # Still below its cap when all lighter ones are full: the first such source fixes the level for the rest.
    t = t.withColumn("open", (F.col("wanted") - F.col("caps_before")) * F.col("weight") < F.col("cap").cast("double") * F.col("weights_onward"))
    left = F.first(F.when(F.col("open"), F.col("wanted") - F.col("caps_before")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0))
    heavy = F.first(F.when(F.col("open"), F.col("weights_onward")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0))
    target = F.coalesce(left * F.col("weight") / heavy, F.col("cap").cast("double"))
    return t.select("source", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken.  Reads the texts once."""
    key = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"))
    # Rows without an id share one key; they are dealt out by size, which comes next in order.
    nameless = hashlib.md5(f"{SEED}:".encode()).hexdigest()
    side = F.when(F.col("key") < nameless, "a").when(F.col("key") > nameless, "c").otherwise(F.concat(F.lit("b"), F.lpad(F.col("size").cast("string"), 19, "0")))
    start = F.substring("key", 1, RANGE_DIGITS)
    rows = rows.withColumn("bucket", F.when(start == nameless[:RANGE_DIGITS], F.concat(start, side)).otherwise(start))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows, _ = materialized(rows.withColumn("upto", F.sum("size").over(within)), "mix")

    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    over_buckets = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(over_buckets), F.lit(0)))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, max_epochs)
    cuts = buckets.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        F.col("b.source").alias("b_source"), F.col("b.bucket").alias("b_bucket"), "before", "source_size", "target"
    )
    joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    whole = F.least(whole, F.lit(max_epochs).cast("long"))
    rest = budget - whole * F.col("source_size")
    start = F.col("before") + F.col("upto") - F.col("size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - start))
    return joined.select("doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: a document stands once for each time it is taken, and
    the one at a source's cut with just the words that fill the budget.  Documents without words stay once
    if their source is taken at all, as they cost nothing."""
    names = docs.columns
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"))
    plan = plan_mix(docs, weights, share, max_epochs).groupBy("doc_id", "source", "size").agg(
        F.min("taken").alias("taken"), F.sum("taken").alias("all_taken"), F.count(F.lit(1)).alias("copies"), F.max("target").alias("target")
    )
    got = mine.join(
        plan, F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_source").eqNullSafe(F.col("source")) & (F.col("_size") == F.col("size"))
    )
    # Rows of equal id, source and size share their words evenly, the first of them a word more if that doesn't go up.
    one, many = got.where("copies = 1").withColumn("words", F.col("taken")), got.where("copies > 1")
    place = Window.partitionBy("_id", "_source", "_size").orderBy(F.xxhash64("row.text"), F.to_json("row"))
    over = (F.row_number().over(place) <= F.col("all_taken") % F.col("copies")).cast("long")
    got = one.union(many.withColumn("words", F.floor(F.col("all_taken") / F.col("copies")).cast("long") + over))
    words = F.col("words")
    full = F.when(F.col("size") > 0, F.floor(words / F.col("size"))).when(F.col("target") > 0, 1).otherwise(0).cast("int")
    rest = F.when(F.col("size") > 0, words % F.col("size")).otherwise(F.lit(0)).cast("long")
    pieces = F.concat(F.array_repeat(F.lit(-1).cast("long"), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    got = got.select("row", F.explode(pieces).alias("n"))
    # substring_index does not know classes of white space; the first n words end where the rest starts.
    head = F.when(F.col("n") < 0, F.col("row.text")).otherwise(first_words(F.col("row.text"), F.col("n")))
    return got.select(*[(head if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in names])


def first_words(text, n):
    """The text up to the end of its ``n``-th word, cut where it stands, white space kept."""
    words = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")


def op4_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
c AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM w),
f AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
         sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_onward,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS wanted
  FROM c),
o AS (SELECT *, (wanted - caps_before) * weight < CAST(cap AS DOUBLE) * weights_onward AS is_open FROM f),
l AS (
  SELECT *, first_value(CASE WHEN is_open THEN wanted - caps_before END IGNORE NULLS) OVER q AS left_over,
         first_value(CASE WHEN is_open THEN weights_onward END IGNORE NULLS) OVER q AS heavy
  FROM o WINDOW q AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT source, source_size, coalesce(CAST(left_over AS DOUBLE) * weight / CAST(heavy AS DOUBLE), CAST(cap AS DOUBLE)) AS target FROM l),
p AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM d),
j AS (
  SELECT p.doc_id, p.size, p.start, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, least(CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END, 2) AS whole FROM j)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, budget - whole * source_size - start)) AS BIGINT) AS taken
FROM e
"""
