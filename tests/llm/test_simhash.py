import itertools
import random

import numpy as np
import pytest
import xxhash

from lanternql.llm import graph, simhash
from tests.llm import cases


def brute_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows, radius=4):
    """(doc_id, fp) -> smallest id reachable of each row."""
    label = {fp: fp for _, fp in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(list(label), 2):
        if (a ^ b).bit_count() <= radius:
            label[root(a)] = root(b)
    least = {}
    for i, fp in rows:
        if i is not None:
            least[root(fp)] = min(least.get(root(fp), i), i)
    return [least.get(root(fp)) for _, fp in rows]


def test_masks_cover_every_pair():
    masks = [m & (2**64 - 1) for m in simhash.masks()]
    assert len(masks) == 31 and all(20 <= m.bit_count() <= 44 for m in masks)
    rng = random.Random(1)
    for _ in range(3000):
        flip = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(flip & m == 0 for m in masks)
    for r in (1, 2, 3):
        small = [m & (2**64 - 1) for m in simhash.masks(r, 10)]
        for bits in itertools.combinations(range(10), r):
            flip = sum(1 << b for b in bits)
            assert any(flip & m == 0 for m in small)


def test_fingerprints():
    rows = cases.documents()
    for r in rows:
        assert simhash.fingerprint(None if r[1] is None else r[1].encode()) == brute_fingerprint(r[1])


def test_documents(spark):
    rng = random.Random(2)
    rows = cases.documents(80)
    for k in range(40):  # near copies: a word changed in a long text
        words = cases.prose(random.Random(9), 400).split()
        words[rng.randrange(400)] = "changed"
        rows.append((1000 + k, " ".join(words), "en", "s", 0))
    got = simhash.near_duplicate_groups(cases.clashing(cases.frame(spark, rows))).collect()
    want = brute_components([(r[0], brute_fingerprint(r[1])) for r in rows])
    as_rows = sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in got)
    assert as_rows == sorted((str(r[0]), brute_fingerprint(r[1]), str(w)) for r, w in zip(rows, want))


@pytest.mark.parametrize("hot", [4096, 8])
def test_links_of_clusters(spark, hot):
    """Clusters of many close fingerprints, with buckets both whole and cut into blocks."""
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    fps |= {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    links = simhash.near_links(nodes, hot=hot).collect()
    assert all((r.u ^ r.v) & (2**64 - 1) and ((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 4 for r in links)
    rows = [(i, f) for i, f in enumerate(fps)]
    want = brute_components(rows)
    roots = {r.node: r.root for r in graph.components(simhash.near_links(nodes, hot=hot)).collect()}
    groups: dict = {}
    for i, f in rows:
        signed = f - 2**64 if f >> 63 else f
        groups.setdefault(roots.get(signed, signed), []).append(i)
    assert sorted(map(min, groups.values())) == sorted(set(want))
    assert sorted(map(len, groups.values())) == sorted(np.unique(want, return_counts=True)[1])


def test_streamed_buckets_over_batches():
    import pyarrow as pa

    keys = [1, 1, 1, 2, 3, 3, 3, 3, 4, 4]
    fps = [0, 1, 3, 5, 8, 8 ^ 1, 1 << 40, 1 << 41, 7, ~7 & (2**63 - 1)]
    whole = None
    for cut in ([10], [1] * 10, [2, 3, 5], [3, 1, 4, 2]):
        at, batches = 0, []
        for n in cut:
            batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + n], pa.int64()), pa.array(fps[at : at + n], pa.int64())], names=["key", "fp"]))
            at += n
        rows = sorted(tuple(r.values()) for b in simhash._buckets(4096, 4)(iter(batches)) for r in b.to_pylist())
        whole = whole or rows
        assert rows == whole and len(rows) >= 4
        hot = [r for b in simhash._buckets(2, 4)(iter(batches)) for r in b.to_pylist() if r["hot"]]
        assert sorted(r["v"] for r in hot) == sorted(fps[:3] + fps[4:8])


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 7), (7, 7), (200, 201), (201, 200), (300 - 1000, 300)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in [*range(1, 41), 100]) and got[201] == 200 and got[300] == -700
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_keep_one(spark):
    rows = cases.documents()
    df = cases.clashing(cases.frame(spark, rows))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = kept.collect()
    want = brute_components([(r[0], brute_fingerprint(r[1])) for r in rows])
    ids = sorted({w for w in want if w is not None})
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == ids
    lone = {brute_fingerprint(r[1]) for r, w in zip(rows, want) if w is None}
    assert len([r for r in got if r.doc_id is None]) == len(lone)
    assert all(r["key"] == "mine key" for r in got)


def test_empty(spark):
    assert simhash.near_duplicate_groups(cases.empty(spark)).collect() == []
    assert simhash.keep_one(cases.empty(spark)).collect() == []


def test_hot_groups_are_joined_apart(spark, monkeypatch):
    from lanternql.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = [(1000 + i, "the same words again and again in one text", "en", "s", 0) for i in range(60)] + cases.documents(30)
    got = simhash.near_duplicate_groups(cases.frame(spark, rows)).collect()
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    want = [(str(i), fp, str(c)) for (i, fp), c in zip(fps, brute_components(fps))]
    assert sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in got) == sorted(want)
    assert sum(c == "1000" for _, _, c in want) == 60
