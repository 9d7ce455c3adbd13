"""Personal data: patterns, and an information-theoretic search for terms that give them away.

Entities are e-mail addresses, IP addresses, card numbers (13 to 19 digits, Luhn) and phone numbers, found by
regular expressions over whole texts.  A term that stands near an entity's occurrences reveals it as far as
the corpus says so: with p(t | e) the share of e's distinct contexts that hold t and p(t) the share of all
documents that do, pointwise mutual information log(p(t | e) / p(t)) is the information t gives about e; e's
own information is -log p(e).  A term whose information is ``DISCLOSURE`` or more of the entity's, seen in at least
``SUPPORT`` different contexts, counts as personal data in the documents that name e.  Copies of one context are
one observation, so mere duplicates of a document don't turn its words into disclosures.  ``sanitize``
generalises entities to their kind and removes disclosing terms.

Everything is DataFrame functions.  Texts are read once for entities and their contexts, once for the
document frequency of the candidate terms, and those of documents with disclosing terms once more.

Defined results: a null text is empty and has no spans; documents are told apart by their text, so null or
repeated ids are no matter and each row given is returned; extra columns are ignored by ``find`` and pass
through ``sanitize`` unchanged; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import identity, materialized, table

KINDS = ("email", "ip", "card", "phone")
#: The patterns, written so that Java's matcher neither recurses nor rescans: quantifiers that never need
#: to give back are possessive, and a run is only entered at its start or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match must hold; most texts are passed over by this.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

REACH = 60
MIN_TERM = 4
SUPPORT = 3
DISCLOSURE = 0.8
TERM = r"[\p{L}\p{N}]{" + str(MIN_TERM) + r",}+"

SPANS = "array<struct<start:long,end:long,match:string>>"


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        # From the right, every second digit counts twice, less 9 if that has two digits.
        doubled = F.transform(
            F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""),
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)),
        )
        total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
        return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """Valid matches with their places: the pieces between matches and the matches, added up."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.split(text, PATTERNS[kind], -1)
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc, m):
        start = acc["at"] + F.length(m["piece"])
        end = start + F.length(m["match"])
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), m["match"].alias("match"))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda m, p: F.struct(p.alias("piece"), m.alias("match")))
    spans = F.aggregate(pairs, state, step, lambda acc: acc["out"])
    spans = F.filter(spans, lambda s: _valid(kind, s["match"]))
    hint = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else text.rlike(PATTERNS[kind])
    if kind == "ip":
        hint = hint & text.rlike(r"[0-9]\.[0-9]")
    return F.when(hint, spans).otherwise(F.array().cast(SPANS))


def _context(text: Column, span: Column) -> Column:
    """The whole words within REACH characters around a span, the span itself left out."""
    start, end = span["start"].cast("int"), span["end"].cast("int")
    size = F.length(text)
    first = F.greatest(F.lit(0), start - REACH)
    left = F.substring(text, first + 1, start - first)
    left = F.when(first > 0, F.regexp_replace(left, r"^[\p{L}\p{N}]+", "")).otherwise(left)
    right = F.substring(text, end + 1, F.least(F.lit(REACH), size - end))
    right = F.when(end + REACH < size, F.regexp_replace(right, r"[\p{L}\p{N}]++$", "")).otherwise(right)
    return F.concat_ws("\n", left, right)


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), a span array for each kind, and ``named``: (entity, context) of every
    entity found."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", identity(F.col("text")).alias("key"), *[_spans(k, F.col("text")).alias(k) for k in KINDS])
    def naming(kind: str) -> Column:
        name = lambda s: F.concat(F.lit(kind + ":"), s["match"])
        return F.transform(kind, lambda s: F.struct(name(s).alias("entity"), F.lower(_context(F.col("text"), s)).alias("context")))

    named = [naming(k) for k in KINDS]
    return rows.select("doc_id", "key", *KINDS, F.concat(*named).alias("named"))


def disclosing(docs: DataFrame, found: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term, ratio): the terms that reveal an entity."""
    extract = lambda c: F.regexp_extract_all(c, F.lit(TERM), F.lit(0))
    seen = found.select(F.explode("named").alias("n")).select(F.col("n.entity").alias("entity"), F.col("n.context").alias("context"))
    contexts = seen.select("entity", F.xxhash64("context").alias("c"), "context").dropDuplicates(["entity", "c"])
    per_entity = contexts.groupBy(F.col("entity").alias("e")).agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= support)
    pairs = contexts.select("entity", F.explode(F.array_distinct(extract(F.col("context")))).alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together"))
    pairs = pairs.where(F.col("together") >= support).join(per_entity, F.col("entity") == F.col("e")).drop("e")
    carriers = found.select(F.explode(F.array_distinct("named.entity")).alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n_entity"))
    n_docs = found.count()
    known = F.log((F.col("together") / F.col("contexts")) / (F.col("n_term") / F.lit(n_docs)))
    own = -F.log(F.col("n_entity") / F.lit(n_docs))
    ratio = F.when(own > 0, known / own).otherwise(F.lit(0.0))
    # A term is in at least as many documents as in contexts of any entity.  That bounds its ratio from above, so
    # everyday words are out before the corpus is asked for the frequency of the rest.
    nearby = F.array_distinct(F.flatten(F.transform("named.context", extract)))
    nearby = found.where(F.size("named") > 0).select(F.explode(nearby).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_term"))
    pairs = pairs.join(carriers, F.col("entity") == F.col("e")).join(nearby, F.col("term") == F.col("t"))
    pairs, _ = materialized(pairs.where(ratio >= disclosure).select("entity", "term", "together", "contexts", "n_entity"), "pairs")
    if pairs.isEmpty():  # nothing whose frequency the corpus would have to tell
        return pairs.select("entity", "term", F.lit(0.0).alias("ratio"))
    # Frequencies are summed before they meet the candidates: the join handles words, not their occurrences.
    words = docs.select(F.explode(F.array_distinct(extract(F.lower("text")))).alias("w"))
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n_term"))
    rated = pairs.join(counts, F.col("term") == F.col("w"))
    return rated.select("entity", "term", ratio.alias("ratio")).where(F.col("ratio") >= disclosure)


def find(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, key, a span array for each kind, and ``term``: the spans of disclosing terms."""
    found, _ = materialized(entities(docs), "entities")
    bad = disclosing(docs, found, support, disclosure).select(F.col("entity").alias("e"), "term")
    named = found.select("key", F.explode("named.entity").alias("entity")).distinct()
    terms = named.join(bad, F.col("entity") == F.col("e")).groupBy("key").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    terms, _ = materialized(terms, "terms")
    texts = docs.select(F.col("text"), identity(F.col("text")).alias("key")).join(terms.withColumnRenamed("key", "k"), F.col("key") == F.col("k"))
    # Terms are letters and digits only, so they need no quoting.
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    spans = texts.select("key", "text", pattern.alias("pattern")).dropDuplicates(["key"])
    spans = spans.select(F.col("key").alias("k"), _term_spans().alias("term"))
    return found.join(spans, F.col("key") == F.col("k"), "left").select("doc_id", "key", *KINDS, F.coalesce("term", F.array().cast(SPANS)).alias("term"))


def _term_spans() -> Column:
    return F.expr(f"""
        aggregate(
          zip_with(regexp_extract_all(text, pattern, 0), split(text, pattern, -1), (m, p) -> struct(p AS piece, m AS match)),
          struct(0L AS at, cast(array() AS {SPANS}) AS out),
          (acc, m) -> if(m.match IS NULL, acc, struct(
            acc.at + length(m.piece) + length(m.match) AS at,
            concat(acc.out, array(struct(acc.at + length(m.piece) AS start, acc.at + length(m.piece) + length(m.match) AS end, m.match AS match))) AS out)),
          acc -> acc.out)""")


def digest(kind: str) -> Column:
    """``kind:start:end`` of a kind's spans, comma-joined."""
    return F.array_join(F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))), ",")


def joined(kinds) -> Column:
    return F.array_join(F.filter(F.array(*[digest(k) for k in kinds]), lambda x: x != ""), ",")


def sanitize(docs: DataFrame) -> DataFrame:
    """``docs`` with entities generalised to ``<kind>`` and disclosing terms removed; of overlapping spans the
    first, longest counts."""
    names = docs.columns
    found = find(docs.select("doc_id", "text")).dropDuplicates(["key"])

    def marking(kind: str) -> Column:
        put = F.lit("" if kind == "term" else f"<{kind}>")
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), put.alias("put")))

    marks = [marking(k) for k in (*KINDS, "term")]
    marks = found.select(F.col("key").alias("_k"), F.array_sort(F.concat(*marks)).alias("_marks")).where(F.size("_marks") > 0)
    rows = docs.withColumn("_key", identity(F.col("text"))).join(marks, F.col("_key") == F.col("_k"), "left")
    clean = F.expr("""
        aggregate(_marks, struct(0L AS at, '' AS out),
          (acc, m) -> if(m.start < acc.at, acc, struct(-m.end AS at, concat(acc.out, substring(text, cast(acc.at + 1 AS int), cast(m.start - acc.at AS int)), m.put) AS out)),
          acc -> concat(acc.out, substring(text, cast(acc.at + 1 AS int))))""")
    return rows.withColumn("text", F.when(F.col("_marks").isNull(), F.col("text")).otherwise(clean)).select(*[F.col(f"`{c}`") for c in names])


def op8_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(KINDS), 256).alias("base_sha256"),
        joined((*KINDS, "term")).alias("spans"),
    )

