import re
from collections import defaultdict

import duckdb
import pytest

from lanternql.llm import common
from lanternql.llm import rollup as q
from tests.llm import cases


def brute(rows):
    out = defaultdict(lambda: [0, 0])
    for r in rows:
        t = r[1] or ""
        for v, n in (("words-1", len(re.findall(r"[^\x20\x09-\x0D]+", t))), ("runs-1", len(re.findall(r"[A-Za-z0-9\x80-\U0010FFFF]+|[!-/:-@\[-`{-~]", t)))):
            out[r[3], r[2], v][0] += 1
            out[r[3], r[2], v][1] += n
    return {k: tuple(v) for k, v in out.items()}


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_batches(spark):
    rows = cases.documents()
    store = q.Rollup(spark, common.shared_path(spark, "test-rollup"))
    assert store.totals().collect() == []
    counts = q.counted(cases.clashing(cases.frame(spark, rows)))
    assert store.commit("one", q.inserts(counts)) and totals(store) == brute(rows)
    assert not store.commit("one", q.inserts(counts)) and totals(store) == brute(rows)
    gone = [r for r in rows if r[0] is not None and r[0] % 3 == 0]
    store.commit("two", q.deletes(q.counted(cases.frame(spark, gone))))
    assert totals(store) == brute([r for r in rows if r not in gone])
    store.commit("empty", q.inserts(q.counted(cases.empty(spark))))
    store.commit("three", q.deletes(q.counted(cases.frame(spark, [r for r in rows if r not in gone]))))
    assert totals(store) == {}


def test_revisions(spark):
    store = q.Rollup(spark, common.shared_path(spark, "test-rollup"))
    rows = [(1, "a*b c", "en", "s", 0), (2, "x y", "en", "s", 0)]
    counts = q.counted(cases.frame(spark, rows), change=q.bare)
    store.commit("a", q.inserts(counts))
    store.commit("b", q.revisions(counts.withColumnsRenamed({"n_tokens": "old_tokens", "changed_tokens": "new_tokens"})))
    assert totals(store) == brute([(1, "a b c", "en", "s", 0), rows[1]])


def test_broken_batch_shows_nothing(spark):
    store = q.Rollup(spark, common.shared_path(spark, "test-rollup"))
    counts = q.counted(cases.frame(spark))
    store.commit("one", q.inserts(counts))
    common.discard(spark, store._folder("one") + "/_SUCCESS")
    assert store.totals().collect() == []
    assert store.commit("one", q.inserts(counts)) and totals(store) == brute(cases.documents())


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = q.op10_token_rollup(spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(q.OP10_SQL).project(", ".join(got.columns)).fetchall())


def test_compaction_changes_no_total(spark):
    rows = cases.documents()
    store = q.Rollup(spark, common.shared_path(spark, "test-rollup"))
    assert store.compact() == 0
    counts = q.counted(cases.frame(spark, rows))
    for n in range(3):
        store.commit(f"b{n}", q.inserts(q.counted(cases.frame(spark, rows[n::3]))))
    before = [f for f, _ in [(f, 0) for f in store._batches()[0]]]
    assert store.compact() == 3 and len(store._batches()[0]) == 1 and totals(store) == brute(rows)
    assert not store.commit("b1", q.inserts(q.counted(cases.frame(spark, rows[1::3])))) and totals(store) == brute(rows)
    store.commit("more", q.deletes(counts))
    assert totals(store) == {} and store.compact() == 2 and totals(store) == {} and len(before) == 3


def test_folders_left_over_by_a_broken_compaction_do_not_count(spark, monkeypatch):
    rows = cases.documents(20)
    store = q.Rollup(spark, common.shared_path(spark, "test-rollup"))
    for n in range(2):
        store.commit(f"b{n}", q.inserts(q.counted(cases.frame(spark, rows[n::2]))))
    with monkeypatch.context() as m:
        m.setattr(q, "discard", lambda spark, path: None)
        store.compact()
    assert totals(store) == brute(rows) and len(store._batches()[0]) == 1


def test_other_deltas_under_a_known_batch_are_an_error(spark):
    rows = cases.documents(20)
    store = q.Rollup(spark, common.shared_path(spark, "test-rollup"))
    store.commit("one", q.inserts(q.counted(cases.frame(spark, rows))))
    with pytest.raises(ValueError):
        store.commit("one", q.inserts(q.counted(cases.frame(spark, rows[1:]))))
    assert totals(store) == brute(rows)


def test_versions_of_tokenizer_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    paths = {v: public_tokenizers.path(f) for v, f in [("bytes-50k", "byte_bpe_50k.json"), ("words-49k", "word_bpe_49k.json")]}
    rows = [r for r in cases.documents(20) if r[0] is not None]
    got = q.counted(cases.frame(spark, rows), {v: q.Tokens(p) for v, p in paths.items()}).collect()
    want = [(r[0], v, len(Tokenizer.from_file(p).encode(r[1] or "", add_special_tokens=False).ids)) for v, p in paths.items() for r in rows]
    assert sorted((r.doc_id, r.tokenizer_version, r.n_tokens) for r in got) == sorted(want)
    assert q.Tokens(paths["bytes-50k"])(b"a word") == 2
