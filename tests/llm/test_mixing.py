import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest

from lanternql.llm import mixing
from tests.llm import cases


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Reshare the excess by weight, round after round, in exact numbers."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def brute(rows):
    size = {s: sum(n_words(r[1]) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    target = brute_targets(size)
    by_source = defaultdict(list)
    for r in rows:
        key = hashlib.md5(f"mix-1:{'' if r[0] is None else r[0]}".encode()).hexdigest()
        by_source[r[3]].append((key, r[0] is not None, r[0] or 0, n_words(r[1]), r[0]))
    out = []
    for s, docs in by_source.items():
        budget = int(target[s])
        whole = min(2, budget // size[s]) if size[s] else 0
        rest = budget - whole * size[s]
        for _, _, _, n, i in sorted(docs, key=lambda d: d[:4]):
            part = max(0, min(n, rest))
            rest -= part
            out.append((str(i), n, size[s], float(target[s]), whole * n + part))
    return sorted(out)


def test_against_brute_force(spark):
    rows = cases.documents(80)
    plan = mixing.plan_mix(cases.clashing(cases.frame(spark, rows))).collect()
    got = sorted((str(r.doc_id), r["size"], r.source_size, r.target, r.taken) for r in plan)
    want = brute(rows)
    assert [(g[0], g[1], g[2], g[4]) for g in got] == [(w[0], w[1], w[2], w[4]) for w in want]
    assert all(g[3] == pytest.approx(w[3], rel=1e-12) for g, w in zip(got, want))
    by_source = defaultdict(int)
    for r in plan:
        assert 0 <= r.taken <= 2 * r["size"]
        by_source[r.source, r.target] += r.taken
    assert all(taken == int(target) for (_, target), taken in by_source.items())


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 0, None: 5}, {"a": 0}, {"a": 1000, "b": 1, "c": 1}, {"a": 5, "b": 5, "c": 5, "d": 100, "é": 7}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(float(want[s])) for s in got)


def test_reruns_agree(spark):
    rows = cases.documents()
    a, b = (sorted(map(str, mixing.plan_mix(cases.frame(spark, r)).collect())) for r in (rows, rows[::-1]))
    assert a == b


def test_mixed_rows(spark):
    rows = cases.documents()
    df = cases.clashing(cases.frame(spark, rows))
    out = mixing.mix(df)
    assert out.columns == df.columns
    taken = defaultdict(int)
    for r in out.collect():
        taken[r.source] += n_words(r.text)
        assert r["size"] == "mine size"
        assert any((r.text or "") == (d[1] or "")[: len(r.text or "")] for d in rows if d[0] == r.doc_id)
    for s, t in brute_targets({s: sum(n_words(r[1]) for r in rows if r[3] == s) for s in {r[3] for r in rows}}).items():
        assert int(t) - 200 <= taken[s] <= int(t)


def test_empty(spark):
    assert mixing.plan_mix(cases.empty(spark)).collect() == [] and mixing.mix(cases.empty(spark)).collect() == []


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(map(tuple, mixing.op4_mix_to_weights(spark, d).collect()))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert got == sorted(c.sql(mixing.OP4_SQL).fetchall())


def test_equal_rows_share_all_their_words(spark):
    rows = [(1, "a b c d e", "en", "s", 0)] * 7 + [(None, f"w{i} x y", "en", "s", 0) for i in range(9)] + [(2, "", "en", "s", 0), (3, " ", "en", "t", 0)]
    out = mixing.mix(cases.frame(spark, rows)).collect()
    taken = sum(n_words(r.text) for r in out if r.source == "s")
    assert taken == sum(r.taken for r in mixing.plan_mix(cases.frame(spark, rows)).collect() if r.doc_id != 3)
    # A document without words stays if its source is taken at all; source t has no words, so its target is 0.
    assert [r.doc_id for r in out if n_words(r.text) == 0] == [2]


def test_rows_without_ids_are_dealt_out(spark):
    rows = [(None, "w " * (1 + i % 40), "en", "s", 0) for i in range(200)] + [(i, "a b c", "en", "s", 0) for i in range(300)]
    got = sorted((str(r.doc_id), r["size"], r.source_size, r.target, r.taken) for r in mixing.plan_mix(cases.frame(spark, rows)).collect())
    assert got == brute(rows)
