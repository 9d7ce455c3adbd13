"""URL filters: explicit rules, and for all other urls a path-template tree.

Paths are split into segments.  Numbers, hexadecimal strings, dates and other mixtures with digits become
typed wildcards at once, file extensions kept.  Then each host's tree is generalised level by level from
the root: literal segments that are rare among their siblings, and whose labels don't tell them from these,
become ``{*}``; siblings whose labelled rates don't differ significantly from those of all their siblings are
one branch, ``{+}``.  Rare segments have few labels, so they are told apart by Chernoff's bound, which holds
for any number of labels, at a level shared out among the siblings.  A
template's purity is its share of bad labels, smoothed by ``PRIOR`` pages at the corpus' own rate; urls of
templates with a purity of ``REJECT`` or more are blocked, all others allowed.

The tree works on counts by host and typed path, not on urls; each level is two aggregates and two
joins, none of which gathers a host in one task.  All of it is DataFrame functions.

Defined results: a null url, or one without ``://``, has an empty host and path; unlabelled templates have
the corpus' rate, without any label nothing is blocked; null page ids are kept; repeated pages count and
are returned each, repeated labels count each; extra columns are ignored; empty in, empty out.  In paths of
more than ``MAX_DEPTH`` segments, the rest of a branch from the ``MAX_DEPTH``-th on stands as one ``{x}`` once
all its labels agree or one typed path is left, so that nothing in it can differ; other branches go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialized, table

#: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Rules are tried one after the other on every url; long lists belong in a join.
MAX_RULES = 2000

MAX_DEPTH = 6
MIN_SHARE = 0.02
#: Bound of the DuckDB equivalent, which pools all literals of a node beyond it; the tree has no such bound.
MAX_LITERALS = 32
Z = 1.96
PRIOR = 10
REJECT = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first ``://`` and the next of / ? # the host, ASCII letters in lower case; from there to ?
    or # the path."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    host = F.when(has, F.translate(F.regexp_extract(url, whole, 1), _UPPER, _LOWER)).otherwise(F.lit(""))
    return host, F.when(has, F.regexp_extract(url, whole, 2)).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, or nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    name = verdict = None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)) if name is None else name.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def typed_segments(path: Column) -> Column:
    """The path's segments with variable ones typed; '' for an empty path is no segment."""

    def typed(s: Column) -> Column:
        stem, ext = F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", ""), F.regexp_extract(s, r"\.[A-Za-z]{1,5}$", 0)
        kind = (
            F.when(stem.rlike(r"^[0-9]+$"), F.lit("{n}"))
            .when(stem.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("{d}"))
            .when(stem.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.lit("{h}"))
            .when(stem.rlike(r"[0-9]"), F.lit("{x}"))
        )
        return F.when(kind.isNotNull(), F.concat(kind, ext)).when(s.startswith("{"), F.lit("{x}")).otherwise(s)

    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.when(path.isin("", "/"), F.array().cast("array<string>")).otherwise(F.transform(parts, typed))


def _told_apart() -> Column:
    """Whether a branch's labels are too unlikely at the rate of all literal siblings: by Chernoff, ``bad`` of ``labelled``
    have a probability of at most exp(-labelled * KL(bad / labelled, p))."""
    n, bad = F.col("labelled"), F.col("bad")
    p = F.try_divide(F.col("literal_bad").cast("double"), F.col("literal_labelled").cast("double"))
    part = lambda k, q: F.when(k > 0, k * F.log(k / n / q)).otherwise(F.lit(0.0))
    far = part(bad, p) + part(n - bad, 1 - p) > F.lit(Z * Z / 2) + F.log(F.col("literals"))
    return F.coalesce((n > 0) & (p > 0) & (p < 1) & far, F.lit(False))


def _settled(tree: DataFrame, k: int) -> DataFrame:
    """``tree`` with the ways of branches that can't split from the k-th segment on cut to one ``{x}`` there."""
    deep = F.size("way") > max(k + 1, MAX_DEPTH)
    branch = tree.where(deep).groupBy(F.col("host").alias("h"), F.col("template").alias("t"))
    branch = branch.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"), F.count(F.lit(1)).alias("paths"))
    done = branch.where("paths = 1 or b = 0 or b = l").select("h", "t")
    rows = tree.join(done, deep & (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")), "left")
    way = F.when(F.col("h").isNotNull(), F.concat(F.slice("way", 1, k), F.array(F.lit("{x}")))).otherwise(F.col("way"))
    return rows.select("host", "segs", way.alias("way"), "n", "labelled", "bad", "template")


def templates(stats: DataFrame) -> DataFrame:
    """``stats``: (host, segs, n, labelled, bad), one row each host and typed path -> (host, segs, template)."""
    spark = stats.sparkSession
    # ``way``: the segments still to be followed, ``segs`` but for a rest that is settled.
    tree, path = materialized(stats.withColumn("template", F.lit("")).withColumn("way", F.col("segs")), "tree")
    depth = tree.agg(F.max(F.size("way")).alias("d")).first().d or 0
    k = 0
    while k < depth:
        if k >= MAX_DEPTH - 1 and depth > max(k + 1, MAX_DEPTH):
            old, (tree, path) = path, materialized(_settled(tree, k), "tree")
            discard(spark, old)
            depth = tree.agg(F.max(F.size("way")).alias("d")).first().d
        seg = F.get("way", F.lit(k))
        child = tree.where(seg.isNotNull()).groupBy("host", "template", seg.alias("seg"))
        child = child.agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")]).withColumn("literal", ~F.col("seg").startswith("{"))
        node = child.groupBy(F.col("host").alias("h"), F.col("template").alias("t")).agg(
            F.sum("n").alias("all_n"), F.sum(F.col("literal").cast("long")).alias("literals"),
            *[F.sum(F.when(F.col("literal"), F.col(c)).otherwise(0)).alias(f"literal_{c}") for c in ("labelled", "bad")],
        )
        same = (F.col("host") == F.col("h")) & (F.col("template") == F.col("t"))
        rare = F.col("literal") & (F.col("n") < F.col("all_n") * F.lit(MIN_SHARE)) & ~_told_apart()
        child = child.join(node, same).select("host", "template", "seg", "labelled", "bad", "literal", rare.alias("rare"))
        common = F.col("literal") & ~F.col("rare")
        pooled = child.where(common).groupBy(F.col("host").alias("h"), F.col("template").alias("t")).agg(
            F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"), F.count(F.lit(1)).alias("branches")
        )
        # One branch's rate against that of all: |bad / labelled - p| <= z * sqrt(p * (1 - p) / labelled).
        p = F.when(F.col("all_labelled") > 0, F.col("all_bad") / F.col("all_labelled")).otherwise(F.lit(0.0))
        gap = F.abs(F.col("bad") - p * F.col("labelled"))
        similar = (F.col("branches") > 1) & (gap <= F.lit(Z) * F.sqrt(p * (1 - p) * F.col("labelled")) + F.lit(1e-9))
        name = F.when(F.col("rare"), F.lit("{*}")).when(common & F.coalesce(similar, F.lit(False)), F.lit("{+}")).otherwise(F.col("seg"))
        named = child.join(pooled, same, "left").select(F.col("host").alias("h"), F.col("template").alias("t"), F.col("seg").alias("s"), name.alias("name"))
        grown = tree.join(named, same & seg.eqNullSafe(F.col("s")), "left")
        grown = grown.select("host", "segs", "way", "n", "labelled", "bad", F.concat("template", F.when(F.col("name").isNotNull(), F.concat(F.lit("/"), F.col("name"))).otherwise(F.lit(""))).alias("template"))
        old, (tree, path) = path, materialized(grown, "tree")
        discard(spark, old)
        k += 1
    return tree


def rule_labels(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, bad): labels of the pages that the rules decide, for ``judge`` to carry over to other templates."""
    host, path = host_and_path(F.col("url"))
    verdict = rule_for(host, path, rules)[1]
    return pages.select(F.col("page_id").cast("long").alias("page_id"), (verdict == "block").alias("bad")).where("page_id is not null and bad is not null")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity.  ``labels``: (page_id, bad boolean)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    # One string stands for the typed path, so that joins compare short keys.
    rows = rows.withColumn("shape", F.array_join(typed_segments(F.col("path")), "/"))
    known = labels.where("page_id is not null and bad is not null").groupBy(F.col("page_id").alias("_page"))
    known = known.agg(F.count(F.lit(1)).alias("labelled"), F.sum(F.col("bad").cast("long")).alias("bad"))
    stats = rows.join(known, F.col("page_id") == F.col("_page"), "left").groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    segs = F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/"))
    tree = templates(stats.select("host", segs.alias("segs"), "n", "labelled", "bad"))
    total = tree.agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l")).first()
    rate = total.b / total.l if total.l else 0.0
    purity = (F.col("bad") + F.lit(PRIOR * rate)) / (F.col("labelled") + F.lit(PRIOR))
    scored = tree.groupBy(F.col("host").alias("h"), F.col("template").alias("t")).agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).select("h", "t", purity.alias("purity"))
    of = tree.select("host", "template", F.array_join("segs", "/").alias("shape")).join(scored, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")))
    of = of.select(F.col("h"), F.col("shape").alias("s"), "template", "purity")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(of, (F.col("host") == F.col("h")) & (F.col("shape") == F.col("s"))).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.concat("host", "template").alias("template"), "purity"
    )


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are those of the document with the page's id: low quality or toxic is bad.  In the given tables hardly
    a page holds anything of that document, so these labels hardly tell templates apart; callers with labels of
    their pages, or with rules alone (``rule_labels``), use ``judge``."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge(table(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")
