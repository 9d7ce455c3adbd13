import random
from collections import Counter

import pyarrow as pa
import pytest

from lanternql.llm import decontaminate as q
from tests.llm import cases

QUESTION = "A train leaves Paris at 9:30 with 240 passengers and travels 410 km north to reach Brussels before noon, how many minutes does John wait if the train is 25 minutes late"
CHANGED = "A train leaves Madrid at 7:15 with 180 passengers and travels 620 km north to reach Lisbon before noon, how many minutes does Anna wait if the train is 40 minutes late"
MUDDLED = "A train leaves Rome at 1:10 with 111 passengers and travels 222 km north to reach Turin before noon, how many minutes does Carl wait if the train is 99 minutes late"


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, key string")


def bench():
    rng = random.Random(8)
    return [(i, cases.prose(rng, 30), "x") for i in range(20)] + [(50, QUESTION, "x"), (51, None, "x"), (52, "", "x"), (53, "too short", "x"), (None, cases.prose(rng, 25), "x")]


def documents():
    rng = random.Random(9)
    b = bench()
    rows = cases.documents(40)
    filler = lambda n: cases.prose(rng, n)
    rows += [
        (500, filler(80) + "\n" + b[3][1] + "\n" + filler(60), "en", "s", 0),
        (501, b[4][1].upper(), "en", "s", 0),
        (502, filler(20) + " " + " ".join(b[5][1].split()[:8]) + " " + filler(20), "en", "s", 0),
        (503, filler(50) + " " + CHANGED + ". " + filler(50), "en", "s", 0),
        (504, filler(5000) + " " + b[6][1].replace(",", " ;") + "\n" + b[7][1], "en", "s", 0),
        (None, b[8][1], "en", "s", 0),
        (505, b[24][1], "en", "s", 0),
        (505, b[24][1], "en", "s", 0),
    ]
    return rows


def naive_windows(text):
    tokens = [w for w in (t.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for t in (text or "").lower().split()) if w]
    return [tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)]


def test_copies(spark):
    rows = documents()
    got = q.find_leaks(cases.clashing(cases.frame(spark, rows)), items(spark, bench())).collect()
    pairs = sorted((str(r.doc_id), str(r.item_id)) for r in got)
    brute = []
    for d in rows:
        here = set(naive_windows(d[1]))
        for i, text, _ in bench():
            w = set(naive_windows(text))
            if w and len(w & here) >= 0.8 * len(w):
                brute.append((str(d[0]), str(i)))
    assert sorted(brute + [("503", "50")]) == pairs
    slots = next(r for r in got if r.doc_id == 503)
    assert slots.literal_coverage < 0.8 <= slots.coverage and slots.slot_consistency >= 0.8


def test_inconsistent_slots_are_no_leak(spark):
    # One value of the item's slots turns into many: 7 stands for 1, 2, 3, 4 and 5.
    item = "Tom buys 7 apples and 7 pears for 7 dollars then sells 7 plums and 7 figs at market"
    same = "Tom buys 4 apples and 4 pears for 4 dollars then sells 4 plums and 4 figs at market"
    other = "Tom buys 1 apples and 2 pears for 3 dollars then sells 4 plums and 5 figs at market"
    b = items(spark, [(1, item, "x")])
    docs = cases.frame(spark, [(1, same, "en", "s", 0), (2, other, "en", "s", 0)])
    assert [r.doc_id for r in q.find_leaks(docs, b).collect()] == [1]


def test_copies_in_other_letter_case(spark):
    names = "In May Alice Brown and Carol Davis took Emma Frank to Great Hill while George Hall stayed at Iron Lake near Jones Kirk"
    b = items(spark, [(1, names, "x"), (2, names.title() + " Long Meadow", "x")])
    texts = [names.upper(), names.lower(), names.title(), "so " + names + " indeed"]
    docs = cases.frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(9, cases.prose(random.Random(1), 90), "en", "s", 0)])
    got = q.find_leaks(docs, b).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, n) for i in range(4) for n in (1, 2)]


def test_scattered_windows_are_no_leak(spark):
    text = bench()[2][1].split()
    rng = random.Random(3)
    scattered = " ".join(" ".join(text[i : i + 6]) + " " + cases.prose(rng, 60) for i in range(0, len(text), 3))
    docs = cases.frame(spark, [(1, scattered, "en", "s", 0)])
    assert q.find_leaks(docs, items(spark, bench())).collect() == []


@pytest.mark.parametrize("block", [32_000_000, 400])
def test_blocks_of_items(spark, block, monkeypatch):
    monkeypatch.setattr(q, "BLOCK_CHARS", block)
    got = q.find_leaks(cases.frame(spark, documents()), items(spark, bench())).collect()
    assert len(got) == 8


def test_without_leaks(spark):
    rows = documents()
    df = cases.clashing(cases.frame(spark, rows))
    out = q.without_leaks(df, items(spark, bench()))
    assert out.columns == df.columns
    kept = sorted(str(r.doc_id) + str(r.text) for r in out.collect())
    gone = {500, 501, 503, 504, 505}
    assert kept == sorted(str(r[0]) + str(r[1]) for r in rows if r[0] not in gone and r[1] != bench()[8][1])


def test_empty(spark):
    b = items(spark, bench())
    none = spark.createDataFrame([], "item_id long, text string")
    assert q.find_leaks(cases.empty(spark), b).collect() == []
    assert q.find_leaks(cases.frame(spark), none).collect() == []
    assert q.without_leaks(cases.frame(spark), none).count() == len(cases.documents())


def test_names_at_the_start_of_sentences(spark):
    item = "Tom has 5 apples. Tom buys 3 more. How many apples does Tom have now?"
    texts = [
        item,
        "Ann has 7 apples. Ann buys 4 more. How many apples does Ann have now?",
        "some words before it. Ann has 7 apples. Ann buys 4 more. How many apples does Ann have now? Some more words",
        "Ann has 7 apples. Bob buys 4 more. How many apples does Carl have now?",
        "Ann has 7 lemons. Ann eats 4 more. How many lemons will Ann want now?",
    ]
    docs = cases.frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    got = q.find_leaks(docs, items(spark, [(1, item, "x")])).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2]


def test_openings_that_differ_undo_nothing(spark):
    # Inside the sentences all is as in the item; The stands for A, So, Yet and Now.
    part = "{} crowd of 12 people met Paul near the old harbour and walked along the quiet river until it was dark again there"
    item, text = (". ".join(part.format(w) for w in ws) for ws in (["The"] * 4, ["A", "So", "Yet", "Now"]))
    text = text.replace("12", "34").replace("Paul", "Rita")
    docs = cases.frame(spark, [(1, text, "en", "s", 0)])
    assert [r.doc_id for r in q.find_leaks(docs, items(spark, [(1, item, "x")])).collect()] == [1]


def test_items_shorter_than_a_window(spark):
    short = [(1, "Capital of France is", "x"), (2, "photosynthesis", "x"), (3, "Who wrote Hamlet?", "x"), (4, "x y", "x"), (5, "?!", "x")]
    texts = [
        "some words, the capital of France is Paris",
        "Photosynthesis",
        "he asked (who wrote Hamlet) twice: who wrote Hamlet?",
        "capital of Spain is, who wrote it, x then y",
        "x",
        "of France is",
    ]
    docs = cases.frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    got = q.find_leaks(docs, items(spark, short)).collect()
    assert sorted((r.doc_id, r.item_id, r.windows, r.first_token, r.last_token) for r in got) == [(0, 1, 1, 3, 6), (1, 2, 1, 0, 0), (2, 3, 1, 2, 4)]


def test_items_of_many_slots(spark):
    # Most windows of five hold fewer than two plain words.
    dense = "Give 12 34 56 78 90 21 43 65 to Alice Brown Carol Davis and 87 98 76 54 32 11 22"
    same = "Give 13 35 57 79 91 22 44 66 to Emma Frank George Hall and 88 99 77 55 33 12 23"
    mixed = "Give 13 13 13 79 91 22 44 66 to Emma Emma Emma Emma and 13 13 13 13 13 13 13"
    other = "Take 13 35 57 79 91 22 44 66 from Emma Frank George Hall or 88 99 77 55 33 12 23"
    numbers = " ".join(str(n) for n in range(10, 40))
    b = items(spark, [(1, dense, "x"), (2, numbers, "x")])
    texts = [dense, "so we say. " + same + ". And more of it follows", other, numbers + " then", " ".join(str(n) for n in range(50, 80))]
    got = q.find_leaks(cases.frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), b).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 1), (1, 1), (3, 2)]
    back = q.find_leaks(cases.frame(spark, [(1, dense, "en", "s", 0)]), items(spark, [(1, mixed, "x")])).collect()
    assert back == []  # one value of the item stands for many


def naive_template(tokens):
    return ["<n>" if t.isdigit() else "<c>" if t[0].isupper() else t for t in tokens]


def naive_reworded(doc, item):
    """Does some stretch of the document hold 0.8 of the item's template windows with consistent slots?"""
    d, i = doc.split(), item.split()
    td, ti = naive_template(d), naive_template(i)
    of = lambda x, k: tuple(x[k : k + 5])
    wants = [k for k in range(len(ti) - 4)]
    for a in range(len(td) - 4):
        pairs = [(p, k) for p in range(a, min(len(td) - 4, a + int(1.5 * len(ti)) + 1)) for k in wants if of(td, p) == of(ti, k)]
        if len({k for _, k in pairs}) < 0.8 * len(wants):
            continue
        first = {}
        for p, k in pairs:
            first.setdefault(k, p)
        same = sum(any(of(d, p) == of(i, k) for p, j in pairs if j == k) for k in wants)
        slots = {(p + j, k + j) for k, p in first.items() for j in range(5) if ti[k + j][0] == "<"}
        votes = Counter((i[y], d[x]) for x, y in slots)
        best = {}
        for (mine, _), n in votes.items():
            best[mine] = max(best.get(mine, 0), n)
        if same >= 0.8 * len(wants) or not votes or sum(best.values()) >= 0.8 * sum(votes.values()):
            return True
    return False


def test_reworded_items_against_brute_force(spark):
    rng = random.Random(21)
    names, plain = ["Anna", "Bert", "Cleo", "Dora", "Emil", "Finn"], "walks over green hills with seven red boats under old trees near quiet rivers before long dark nights come back".split()
    plain.remove("seven")
    made, texts = [], []
    for i in range(12):
        words = [rng.choice(plain)]
        while len(words) < 16:  # a slot after every two or three plain words
            words += rng.sample(plain, rng.randint(2, 3)) + [rng.choice(names) if rng.random() < 0.5 else str(rng.randint(2, 9))]
        made.append((i, " ".join(words), "x"))
        pick = lambda w, to: to.setdefault(w, rng.choice(names) if w in names else str(rng.randint(11, 99))) if w in names or w.isdigit() else w
        to: dict = {}
        texts.append(" ".join(pick(w, to) for w in words))  # all slots changed alike
        texts.append(" ".join(pick(w, {}) for w in words))  # each slot for itself
        texts.append(" ".join(rng.choice(plain) if rng.random() < 0.15 else w for w in words))
        texts.append(" ".join(words[:9]))
    texts = [" ".join([rng.choice(plain) for _ in range(10)] + t.split() + [rng.choice(plain) for _ in range(10)]) for t in texts]
    want = sorted((d, i) for d, t in enumerate(texts) for i, item, _ in made if naive_reworded(t, item))
    got = q.find_leaks(cases.frame(spark, [(d, t, "en", "s", 0) for d, t in enumerate(texts)]), items(spark, made)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == want and len(want) > 15


def test_words_in_bulk_and_one_by_one():
    rng = random.Random(2)
    words = [w for r in cases.documents() for w in (r[1] or "").split()] + "Paris. PARIS paris! (Rome) 12 3,5% 5km seven Seven SEVEN. km Km: Über ÜBER straße STRAßE ª İx don't a-b … — “Yes” no?” ½ $5 #!".split()
    words += ["".join(rng.choices("aAbB1.,'éÉß!?:)“”%-", k=rng.randint(1, 6))) for _ in range(3000)]
    words = sorted(set(words))
    canon = q.Canon()
    canon.learn(pa.array(words))
    assert list(zip(canon.literal.tolist(), canon.template.tolist(), canon.flags.tolist())) == [q.canonical(w) for w in words]
