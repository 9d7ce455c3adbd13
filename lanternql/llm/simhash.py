"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's 4-word shingles.  For radius r,
every bit gets one of the 2^(r+1) - 1 non-zero vectors of F_2^(r+1); table v masks the bits whose vector
has an odd inner product with v.  Any r differing bits span at most r dimensions, so some v is orthogonal
to all of them and the pair agrees under that table's mask: every pair within the radius collides in at
least one of the 31 tables, for certain, with masks of about 32 bits.

Equal fingerprints are merged first.  Buckets stream through a task in key order; a bucket yields a
spanning forest of its links, at most one row for each member, found by searching outward from one member
at a time, so groups of copies never become pairs.  Buckets beyond ``HOT`` members are cut into blocks
and every two blocks meet in a task of their own.

Defined results: null or word-less texts have fingerprint zero and are linked like any other.  A null
doc_id never becomes a component's id unless all its ids are null.  Repeated rows stay repeated.  Extra
columns are ignored.  Texts are processed whole; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialized, releasing, spread_join, table, to_python
from .graph import components

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
#: Members of a bucket that one task compares; larger ones are cut into blocks of half as many.
HOT = 4096


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, h.size, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > h.size, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return to_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(releasing(run), "doc_id long, fp long")


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering masks as signed longs; any two values within the radius agree under one of them."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(bits)]
    out = []
    for v in range(1, top):
        m = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)
        out.append(m - (1 << bits) if m >> (bits - 1) else m)
    return out


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within the radius among distinct fingerprints."""
    edges: list[tuple[int, int]] = []
    rest = fps
    while rest.size > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            p = queue.pop()
            near = np.bitwise_count(rest ^ p) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found)
                edges.extend((int(p), int(f)) for f in found)
    return edges


def _buckets(limit: int | None, radius: int):
    """Arrow function over rows (key, fp) sorted by key -> rows (u, v, hot).

    hot false: a link of two fingerprints.  hot true: u is the key and v a member of a bucket beyond limit.
    Rows that collide are compared themselves, so a collision of keys costs time and nothing else.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("hot", pa.bool_())])

    def emit(links, hot):
        u = np.array([x[0] for x in links] + [x[0] for x in hot], np.uint64).view(np.int64)
        v = np.array([x[1] for x in links] + [x[1] for x in hot], np.uint64).view(np.int64)
        flags = np.arange(u.size) >= len(links)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(flags)], schema=schema)

    def run(batches):
        held_key, held, over = None, np.empty(0, np.uint64), False
        for b in batches:
            keys = b.column(0).to_numpy().view(np.uint64)
            fps = b.column(1).to_numpy().view(np.uint64)
            if not keys.size:
                continue
            links: list = []
            hot: list = []

            def close(key, members, over):
                if over or (limit is not None and members.size > limit):
                    hot.extend((int(key), int(x)) for x in members)
                elif members.size > 1:
                    links.extend(forest(np.unique(members), radius))

            if held_key is not None and keys[0] != held_key:
                close(held_key, held, over)
                held_key, held, over = None, np.empty(0, np.uint64), False
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.append(at, keys.size))
            if held_key is not None:  # the bucket of the batch before goes on
                held = np.concatenate((held, fps[: size[0]]))
                at, size = at[1:], size[1:]
                if at.size:
                    close(held_key, held, over)
            if at.size:  # the last bucket may go on in the next batch
                held_key, held, over = keys[at[-1]], fps[at[-1] :], False
                at, size = at[:-1], size[:-1]
            if limit is not None and held.size > limit:
                hot.extend((int(held_key), int(x)) for x in held)
                held, over = held[:0], True
            two = at[size == 2]
            near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
            links.extend(zip(fps[near].tolist(), fps[near + 1].tolist()))
            for a, n in zip(at[size > 2].tolist(), size[size > 2].tolist()):
                close(keys[a], fps[a : a + n], False)
            if links or hot:
                yield emit(links, hot)
        links, hot = [], []
        if over or (limit is not None and held.size > limit):
            hot = [(int(held_key), int(x)) for x in held]
        elif held.size > 1:
            links = forest(np.unique(held), radius)
        if links or hot:
            yield emit(links, hot)

    return run


def near_links(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(u, v): links of distinct fingerprints (column fp) whose components are those of all links within
    the radius."""
    fp = F.col("fp")
    keyed = nodes.select(F.explode(F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(m))) for i, m in enumerate(masks(radius))])).alias("key"), "fp")
    shape = "u long, v long, hot boolean"
    found, _ = materialized(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_buckets(hot, radius), shape), "buckets")
    large = found.where("hot").select(F.col("u").alias("key"), F.col("v").alias("fp"))
    blocks = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(max(1, hot // 2))).cast("int").alias("blocks")).withColumnRenamed("key", "k")
    cut = large.join(blocks, F.col("key") == F.col("k")).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cut = cut.select("key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cut = cut.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fp")
    more = cut.repartition("key").sortWithinPartitions("key").mapInArrow(_buckets(None, radius), shape)
    return found.where("not hot").select("u", "v").union(more.select("u", "v"))


def near_duplicate_groups(docs: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id, root): component_id is the smallest doc_id reachable over links of fingerprints
    that differ in at most ``radius`` bits, root a fingerprint that names the group."""
    fps, _ = materialized(fingerprints(docs), "fingerprints")
    nodes, _ = materialized(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "nodes")
    root = components(near_links(nodes.select("fp"), radius, hot))
    # A root is no node of its own rows; it joins its group through itself.
    member = nodes.join(root, F.col("fp") == F.col("node"), "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    member, _ = materialized(member, "members")
    sizes = member.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    label = member.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    # Neither a large group nor a fingerprint of many copies lands in one task.
    label = spread_join(member, label, "root", "r", "n", sizes.nodes).select(F.col("fp").alias("f"), "component_id", "root", "copies")
    return spread_join(fps, label, "fp", "f", "copies", sizes.rows).select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """``docs`` with one document of each group: that whose doc_id is the group's id.

    Rows that repeat a doc_id leave one row, the one with the least text.  Documents without an id give
    way to any with one; of a group that has no id at all one document stays.
    """
    names = docs.columns
    groups, _ = materialized(near_duplicate_groups(docs, radius, hot), "groups")
    winners = groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    winners = winners.select(F.col("doc_id").alias("_id"), "n")
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("_key"))
    once = rows.join(winners.where("n = 1"), F.col("_key") == F.col("_id"), "left_semi").select("row")
    least = F.min_by("row", F.struct(F.col("row.text"), F.to_json("row"))).alias("row")
    again = rows.join(winners.where("n > 1"), F.col("_key") == F.col("_id"), "left_semi").groupBy("_key").agg(least).select("row")
    nameless = groups.where("component_id is null").groupBy("root").agg(F.min("fp").alias("_fp")).select("_fp")

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts)).view(np.int64))

    blank = docs.where("doc_id is null").select(whole, fp(F.col("text").cast("binary")).alias("_key"))
    blank = blank.join(nameless, F.col("_key") == F.col("_fp"), "left_semi").groupBy("_key").agg(least).select("row")
    rows = once.unionByName(again).unionByName(blank)
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def op5_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
