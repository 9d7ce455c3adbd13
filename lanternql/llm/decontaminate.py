"""Benchmark decontamination by template canonicalisation.

Texts become sequences of tokens: words in lower case without the punctuation around them.  In the
template form numbers, units and names (capitalised words inside a sentence) turn into typed
placeholders.  Windows of five template tokens are hashed, and those with placeholders a second time by
their words; a capitalised word that begins a sentence may be a name or not, so windows with such words are
hashed in both forms.  Documents' windows meet the benchmark's by hash.  A document holds an item if at least 0.8 of the item's windows, each counted once, stand in one
stretch of it no longer than the item times ``STRETCH``, and if either at least 0.8 of them agree word
for word, or the slots are consistent: the values in the item's slots map to the document's values as a
function, but for 0.2 of the slots; a word that begins a sentence is a slot only where it differs.  So copies and re-parameterised questions are caught, while texts that
merely share a pattern of placeholders are not; a window with fewer than ``MIN_LITERALS`` plain words is widened
to both sides until it holds so many.  An item shorter than a window is held by the documents in which all its
tokens stand one after the other.

The benchmark is the small side.  Its size is measured first; up to ``BLOCK_CHARS`` characters go to the
executors at once, and a larger benchmark goes in as many blocks of items as that takes, each held against
all documents.  Documents are read whole, one at a time.

Defined results: null or empty texts, on either side, match nothing; null ids are returned as null; repeated documents or items give a
row each; extra columns are ignored by ``find_leaks`` and pass through ``without_leaks`` unchanged; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Numbers, identity, per_worker, releasing, table, text_of, to_python

WINDOW = 5
COVERAGE = 0.8
STRETCH = 1.5
MIN_LITERALS = 2
SLOT_CONSISTENCY = 0.8
BLOCK_CHARS = 32_000_000
#: Words of which a worker keeps the canonical form, and their bytes: the memory bound of a cache, not of the result.
CACHE_WORDS = 1_000_000
CACHE_BYTES = 24 << 20

#: Words that name numbers and units.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNIT_WORDS = frozenset("mm cm m km inch inches foot feet yard yards mile miles g kg mg ton tons gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees mph kmh".split())
NUMBER = re.compile(r"[+-]?[$€£¥]?\d+(?:[.,:/]\d+)*%?")
QUANTITY = re.compile(r"\d+(?:[.,]\d+)*([a-z]+)")

_NUM, _UNIT, _NAME, _QUANTITY = "\x00num", "\x00unit", "\x00name", "\x00quantity"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

PAIR = "doc_id long, item_id long, windows int, coverage double, literal_coverage double, slot_consistency double, first_token int, last_token int"


def _hash(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s)


#: Flags of a word.
CAPITAL, ENDS, SLOT, DROPPED = 1, 2, 4, 8
_AROUND = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^`{|}~«»“”‘’„…¿¡–—"


def canonical(word: str) -> tuple[int, int, int]:
    """(hash of the literal form, hash of the template form, flags) of a word."""
    bare = word.strip(_AROUND)
    if not bare.isalpha():
        bare = re.sub(r"^[^\w$€£¥+-]+|[^\w%]+$", "", word)
    low = bare.lower()
    literal = _hash(low)
    kind = None
    if low in NUMBER_WORDS:
        kind = _NUM
    elif low in UNIT_WORDS or low == "%":
        kind = _UNIT
    elif not low.isalpha():
        if NUMBER.fullmatch(low):
            kind = _NUM
        elif (m := QUANTITY.fullmatch(low)) and m[1] in UNIT_WORDS:
            kind = _QUANTITY
    flags = SLOT if kind else 0
    if not kind and bare[:1].isupper() and not bare.isupper():
        flags |= CAPITAL
    if word.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":"):
        flags |= ENDS
    if not low:
        flags |= DROPPED
    return literal, _hash(kind) if kind else literal, flags


class Tokens:
    """The tokens of texts as arrays: ``doc`` they are in, hashes of both forms, whether they are slots, and
    whether they may be names at the start of a sentence."""

    COLUMNS = ("doc", "literal", "template", "slot", "opening")

    def __init__(self, *columns: np.ndarray):
        self.doc, self.literal, self.template, self.slot, self.opening = columns

    def part(self, a: int, z: int) -> Tokens:
        return Tokens(*(getattr(self, c)[a:z] for c in self.COLUMNS))


class Canon:
    """Turns texts into tokens.  A word's forms are worked out once and looked up after."""

    def __init__(self):
        self.numbers = Numbers(CACHE_WORDS, CACHE_BYTES)
        self.forget()
        self.name = np.uint64(_hash(_NAME))

    def forget(self) -> None:
        self.literal, self.template, self.flags = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)

    def learn(self, words: pa.Array) -> None:
        """``canonical`` of all words, for those of common letters at once."""
        n = len(words)
        literal, template, flags = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint8)
        bare = pc.utf8_trim(words, characters=_AROUND)
        simple = pc.match_substring_regex(bare, "^[A-Za-zÀ-ÖØ-öø-ÿ]+$")
        bare = bare.filter(simple)
        low = pc.utf8_lower(bare).dictionary_encode()
        hashes = np.fromiter(map(_hash, low.dictionary.to_pylist()), np.uint64, len(low.dictionary))
        kinds = hashes.copy()
        flag = lambda column: column.to_numpy(zero_copy_only=False)
        number, unit = (flag(pc.is_in(low.dictionary, value_set=pa.array(sorted(ws)))) for ws in (NUMBER_WORDS, UNIT_WORDS))
        kinds[unit], kinds[number] = _hash(_UNIT), _hash(_NUM)
        plain = ~(number | unit)
        of = low.indices.to_numpy()
        at = flag(simple)
        capital = flag(pc.utf8_is_upper(pc.utf8_slice_codeunits(bare, 0, 1))) & ~flag(pc.utf8_is_upper(bare)) & plain[of]
        literal[at], template[at] = hashes[of], kinds[of]
        ends = flag(pc.match_substring_regex(words, "[.!?:][\"')\\]}»”’]*$"))
        flags[at] = np.where(capital, CAPITAL, 0) | np.where(plain[of], 0, SLOT) | np.where(ends[at], ENDS, 0)
        rest = np.flatnonzero(~at)
        for i, word in zip(rest.tolist(), words.take(pa.array(rest)).to_pylist()):
            literal[i], template[i], flags[i] = canonical(word)
        self.literal, self.template, self.flags = (np.concatenate(x) for x in ((self.literal, literal), (self.template, template), (self.flags, flags)))

    def __call__(self, texts: pa.Array) -> Tokens:
        words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(text_of(texts)))
        at, new, anew = self.numbers(words.flatten())
        if anew:
            self.forget()
        if len(new):
            self.learn(new)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(words.offsets.to_numpy()))
        flags = self.flags[at]
        keep = flags & DROPPED == 0
        ends = flags & ENDS != 0
        inside = np.zeros(at.size, bool)  # not at the start of a sentence
        inside[1:] = (doc[1:] == doc[:-1]) & ~ends[:-1]
        if not keep.all():
            # Runs of marks are no tokens, but may have ended a sentence.
            at, doc, inside, flags = at[keep], doc[keep], inside[keep], flags[keep]
        literal, template = self.literal[at], self.template[at]
        name = inside & (flags & CAPITAL != 0)
        template[name] = self.name
        return Tokens(doc, literal, template, name | (flags & SLOT != 0), ~inside & (flags & CAPITAL != 0))


def _mixed(parts) -> np.ndarray:
    """Hash of the windows whose j-th tokens are the j-th of ``parts``."""
    h = None
    for part in parts:
        h = part.copy() if h is None else h * _FACTOR + part
    return h ^ (h >> np.uint64(29))


def _spans(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hash of the tokens from each start to its stop, of any length."""
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(values.size, _FACTOR))))
    back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(values.size, _INVERSE))))
    upto = np.concatenate(([np.uint64(0)], np.cumsum(values * powers[:-1])))
    h = (upto[stops] - upto[starts]) * back[starts] + (stops - starts).astype(np.uint64) * _INVERSE
    return h ^ (h >> np.uint64(31))


def _widened(doc: np.ndarray, values: np.ndarray, plain: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts again, hash): windows with too few plain words, widened to the right, and to the left, until they
    hold enough; those that reach the end of their text before that are left out."""
    places = np.flatnonzero(plain)
    first, end = np.searchsorted(doc, doc[starts]), np.searchsorted(doc, doc[starts], "right")
    stops = starts + WINDOW
    right = np.searchsorted(places, starts) + MIN_LITERALS - 1
    left = np.searchsorted(places, stops) - MIN_LITERALS
    at = np.append(places, values.size)[np.minimum(right, places.size)] + 1
    fits = at <= end
    back = np.where(left >= 0, places[np.maximum(left, 0)] if places.size else 0, -1)
    fits_left = back >= first
    return np.concatenate((starts[fits], starts[fits_left])), np.concatenate((_spans(values, starts[fits], at[fits]), _spans(values, back[fits_left], stops[fits_left])))


def windows(t: Tokens, name: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, starts of all windows): each window by its template, widened where that has too few plain
    words; one with slots by its words too, so that copies are found whatever became of capital letters; and one
    with words that begin a sentence by the template in which they are names."""
    n = max(0, t.doc.size - WINDOW + 1)
    inside = t.doc[:n] == t.doc[WINDOW - 1 : WINDOW - 1 + n]
    count = lambda marks: sum((marks[j : j + n].view(np.uint8) for j in range(1, WINDOW)), marks[:n].view(np.uint8))
    slots, openings = count(t.slot), count(t.opening)
    h = _mixed(t.template[j : j + n] for j in range(WINDOW))
    few = WINDOW - MIN_LITERALS
    by_template = np.flatnonzero(inside & (slots <= few))
    by_words = np.flatnonzero(inside & (slots > 0))
    worded = _mixed(t.literal[by_words + j] for j in range(WINDOW))
    by_name = np.flatnonzero(inside & (openings > 0) & (slots + openings <= few))
    named = np.where(t.opening, name, t.template)
    places, hashes = [by_template, by_words, by_name], [h[by_template], worded, _mixed(named[by_name + j] for j in range(WINDOW))]
    dense = np.flatnonzero(inside & (slots > few))
    dense_named = np.flatnonzero(inside & (openings > 0) & (slots + openings > few))
    for starts, values, plain in ((dense, t.template, ~t.slot), (dense_named, named, ~(t.slot | t.opening))):
        if starts.size:
            at, wide = _widened(t.doc, values, plain, starts)
            places.append(at)
            hashes.append(wide)
    return np.concatenate(places), np.concatenate(hashes), np.flatnonzero(inside)


def short_runs(t: Tokens, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of every run of ``size`` tokens, by its words; sizes don't meet."""
    n = max(0, t.doc.size - size + 1)
    starts = np.flatnonzero(t.doc[:n] == t.doc[size - 1 : size - 1 + n])
    return starts, _mixed([np.full(starts.size, size, np.uint64), *(t.literal[starts + j] for j in range(size))])


class Benchmark:
    """A block of items, ready to be held against documents."""

    def __init__(self, ids: list[int | None], texts: pa.Array, canon: Canon):
        self.ids, self.tokens = ids, canon(texts)
        t = self.tokens
        at, h, starts = windows(t, canon.name)
        self.starts = np.searchsorted(t.doc, np.arange(len(ids) + 1))
        order = np.argsort(h, kind="stable")
        self.at, self.hashes, self.item = at[order], h[order], t.doc[at][order]
        self.needed = np.bincount(t.doc[starts], minlength=len(ids))
        self.seen = _marks(self.hashes)
        # Items shorter than a window: all of their words, one after the other.
        self.short = {}
        sizes = np.diff(self.starts)
        for size in sorted(set(sizes[(sizes > 0) & (sizes < WINDOW)].tolist())):
            of = np.flatnonzero(sizes == size)
            h = _mixed([np.full(of.size, size, np.uint64), *(t.literal[self.starts[of] + j] for j in range(size))])
            order = np.argsort(h, kind="stable")
            self.short[size] = of[order], h[order], _marks(h)

    def __call__(self, ids: list, texts: pa.Array, canon: Canon) -> list[tuple]:
        every = canon(texts)
        ends = np.searchsorted(every.doc, np.arange(len(ids) + 1))
        out, first = [], 0
        while first < len(ids):  # whole documents, some 2^18 tokens of them at a time
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + (1 << 18), "right")) - 1)
            out += self.held(ids, every.part(int(ends[first]), int(ends[last])), canon)
            first = last
        return out

    def held(self, ids: list, t: Tokens, canon: Canon) -> list[tuple]:
        at, h, _ = windows(t, canon.name)
        hit, lo, hi = _meeting(h, self.hashes, self.seen)
        found = defaultdict(set)
        for p, a, z in zip(at[hit].tolist(), lo.tolist(), hi.tolist()):
            for k in range(a, z):
                found[int(t.doc[p]), int(self.item[k])].add((p, int(self.at[k])))
        out = []
        for (d, i), pairs in found.items():
            if len({q for _, q in pairs}) >= COVERAGE * self.needed[i] and (row := self.best(sorted(pairs), i, t)):
                start = int(np.searchsorted(t.doc, d))
                out.append((ids[d], self.ids[i], int(self.needed[i]), *row[:3], row[3] - start, row[4] - start))
        for size, (of, hashes, seen) in self.short.items():
            at, h = short_runs(t, size)
            hit, lo, hi = _meeting(h, hashes, seen)
            places: dict[tuple[int, int], int] = {}
            for p, a, z in zip(at[hit].tolist(), lo.tolist(), hi.tolist()):
                for k in range(a, z):
                    places.setdefault((int(t.doc[p]), int(of[k])), p)
            for (d, i), p in places.items():
                start = int(np.searchsorted(t.doc, d))
                out.append((ids[d], self.ids[i], 1, 1.0, 1.0, 1.0, p - start, p - start + size - 1))
        return out

    def best(self, pairs: list[tuple[int, int]], i: int, t: Tokens):
        """The first stretch with enough windows: coverage, literal coverage, consistency, first and last token."""
        need = int(self.needed[i])
        reach = STRETCH * (self.starts[i + 1] - self.starts[i])
        inside: dict[int, list[int]] = defaultdict(list)
        left = 0
        for right, (p, q) in enumerate(pairs):
            inside[q].append(p)
            while p - pairs[left][0] > reach:
                old = pairs[left]
                inside[old[1]].remove(old[0])
                if not inside[old[1]]:
                    del inside[old[1]]
                left += 1
            # Judged when full, or when the stretch can't grow: the next window is out of reach.
            last = right + 1 == len(pairs) or pairs[right + 1][0] - pairs[left][0] > reach
            if len(inside) >= COVERAGE * need and (len(inside) == need or last):
                row = self.judged(pairs[left : right + 1], need, t)
                if row:
                    return row
        return None

    def judged(self, pairs, need, t: Tokens):
        own, step = self.tokens, np.arange(WINDOW)
        by_window: dict[int, list[int]] = defaultdict(list)
        for p, q in pairs:
            by_window[q].append(p)
        same = 0
        votes: dict[tuple[int, int], int] = defaultdict(int)
        seen = set()
        for q, places in by_window.items():
            words = own.literal[q + step]
            equal = [bool((t.literal[p + step] == words).all()) for p in places]
            same += any(equal)
            p = places[equal.index(True)] if any(equal) else places[0]
            for j in range(WINDOW):
                if (own.slot[q + j] or own.opening[q + j]) and (t.slot[p + j] or t.opening[p + j]) and (p + j, q + j) not in seen:
                    seen.add((p + j, q + j))
                    here, there = int(own.literal[q + j]), int(t.literal[p + j])
                    if here != there or own.slot[q + j] and t.slot[p + j]:
                        votes[here, there] += 1
        most: dict[int, int] = defaultdict(int)
        for (mine, _), n in votes.items():
            most[mine] = max(most[mine], n)
        total = sum(votes.values())
        consistent = sum(most.values()) / total if total else 1.0
        if same >= COVERAGE * need or consistent >= SLOT_CONSISTENCY:
            return len(by_window) / need, same / need, consistent, pairs[0][0], pairs[-1][0] + WINDOW - 1
        # Openings that differ, such as The and A, don't undo what windows without them show.
        plain = [(p, q) for p, q in pairs if self.same_openings(p, q, t)]
        if len(plain) < len(pairs) and len({q for _, q in plain}) >= COVERAGE * need:
            return self.judged(plain, need, t)
        return None

    def same_openings(self, p: int, q: int, t: Tokens) -> bool:
        own = self.tokens
        return all(own.literal[q + j] == t.literal[p + j] for j in range(WINDOW) if own.opening[q + j] or t.opening[p + j])


def _marks(hashes: np.ndarray) -> np.ndarray:
    """The leading bits that occur among the hashes."""
    seen = np.zeros(1 << 20, bool)
    seen[(hashes >> np.uint64(44)).astype(np.int64)] = True
    return seen


def _meeting(h: np.ndarray, hashes: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of ``h`` are among the sorted ``hashes``, and where these begin and end there."""
    hit = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
    lo, hi = np.searchsorted(hashes, h[hit], "left"), np.searchsorted(hashes, h[hit], "right")
    return hit[hi > lo], lo[hi > lo], hi[hi > lo]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, windows (of the item), coverage,
    literal_coverage, slot_consistency, first_token and last_token (the stretch, counted in tokens).  Ids are whole numbers, or bytes."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    block = F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks))
    kind = "binary" if dict(docs.dtypes)["doc_id"] == "binary" else "long"
    rows = to_python(docs).select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    out = None
    for k in range(blocks):
        part = [(r.item_id, bytes(r.text)) for r in items.where(block == k).orderBy("item_id", "text").collect()]
        found = rows.mapInArrow(releasing(_finder(docs.sparkSession, part, kind)), PAIR.replace("long", kind, 1))
        out = found if out is None else out.union(found)
    return out


def _finder(spark: SparkSession, items: list[tuple[int | None, bytes]], kind: str = "long"):
    """The search for one block of items, which goes to each executor once and is indexed once a worker."""
    sent = spark.sparkContext.broadcast(items)
    name = zlib.crc32(repr(items).encode())
    schema = pa.schema([(c.split()[0], {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]]) for c in PAIR.replace("long", kind, 1).split(", ")])

    def run(batches):
        def ready():
            canon = Canon()
            return canon, Benchmark([i for i, _ in sent.value], pa.array([x for _, x in sent.value], pa.binary()), canon)

        canon, known = per_worker(("decontaminate", name), ready)
        for b in batches:
            rows = known(b.column(0).to_pylist(), b.column(1), canon)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, unchanged.  A document without an id is judged by its text:
    ids are replaced by a text hash of 128 bits for the search, so null and repeated ids do no harm."""
    key = identity(F.col("text"))
    leaks = find_leaks(docs.select(key.alias("doc_id"), F.col("text")), benchmark).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.withColumn("_key", key).join(leaks, F.col("_key") == F.col("_leak"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
