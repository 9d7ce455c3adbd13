import random
import re
from collections import Counter

import numpy as np
import pytest

from lanternql.llm import quality_rules as q
from tests.llm import cases


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)]


@pytest.fixture
def rows():
    rng = random.Random(4)
    rows = cases.documents(60)
    clean = [cases.prose(rng, 150) for _ in range(4)]
    rows += [
        (900, "\n".join(["Same line here.", clean[0], "Same line here.", " ", " ", "Same line here."]), "en", "s", 0),
        (901, " ".join(["spam"] * 120), "en", "s", 0),
        (902, " ".join(w.upper() + "!!" for w in clean[1].split()), "en", "s", 0),
        (903, " ".join(w + rng.choice(["%%%", "***", "$$$", "&&&"]) for w in clean[2].split()), "en", "s", 0),
        (904, " | ".join(clean[3].split()), "en", "s", 0),
        (905, clean[0] + " " + " ".join(clean[0].split()[:40]), "en", "s", 0),
        (906, "a b c a b c a b a", "en", "s", 0),
    ]
    return rows


def test_counts_and_verdicts(spark, rows):
    got = q.judge(cases.clashing(cases.frame(spark, rows))).collect()
    as_rows = sorted((str(r.doc_id), [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words]) for r in got)
    assert as_rows == sorted((str(r[0]), brute_counts(r[1])) for r in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[i] for i in (901, 902, 903, 904, 906)) and kept[900] and kept[905]
    assert all(kept[i] for i in range(60)), "clean documents stay"


def test_distances():
    p = np.array([3, 1, 0])
    assert q.distances(p, np.array([[0.75, 0.25, 0.0], [0.0, 0.0, 1.0]])) == pytest.approx([0, 1])


def test_short_texts_have_no_distance(spark):
    rows = cases.documents(60) + [(950, " ".join(["%|%"] * 30 + ["a"] * 30), "en", "s", 0)]
    r = next(r for r in q.judge(cases.frame(spark, rows)).collect() if r.doc_id == 950)
    assert r.char_distance is None or r.n_words >= 50


def test_keep_good(spark, rows):
    df = cases.clashing(cases.frame(spark, rows))
    kept = q.keep_good(df)
    assert kept.columns == df.columns
    want = sorted(str(r.doc_id) for r in q.judge(df).collect() if r.kept)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_order_does_not_matter(spark, rows):
    a, b = (q.references(cases.frame(spark, r)) for r in (rows, rows[::-1]))
    for x, y in zip(a, b):
        assert x.keys() == y.keys() and all((x[k] == y[k]).all() for k in x)


def test_empty(spark):
    assert q.judge(cases.empty(spark)).collect() == [] and q.keep_good(cases.empty(spark)).collect() == []


def test_labelled(spark):
    """On the labelled rows of the small tables junk goes and clean documents stay."""
    d = "/root/testdata/sf0.01"
    got = q.op2_divergence_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) >= 0.98 * len(got)
