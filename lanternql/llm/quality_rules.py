"""Quality rules by distribution divergence.

Two histograms of a document, its characters by class and its words by common word, are held against
references of the languages by Jensen-Shannon distance (base 2, so 0 to 1).  The references come from all
documents of a language in a first pass over the whole corpus: the median share of each class, which junk
cannot pull while it is the lesser part, and the mean share of each word.  They are a few numbers a
language whatever the corpus is.  A document is rejected if it is far from every language.
Short documents give no reliable histogram: below ``MIN_CHARS`` characters no character distance is
judged, below ``MIN_COMMON`` words no word distance.

Plain counts go before: documents of fewer than 50 words, or with more than half of their words in
repeated 3-word windows, fail at once.

Defined results: a null text has no words and fails; a null or unlisted language adds to the reference
``other``; a language with fewer than ``MIN_DOCS`` documents gives no reference, and without any reference
the plain counts alone decide.  Repeated rows are judged alike and add to the references each.  Extra
columns pass through ``keep_good`` unchanged.  An empty table gives an empty table.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Numbers, per_worker, releasing, table, text_of, to_python

LANGUAGES = ("de", "en", "es", "fr")
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Frequent function words of the four languages.
COMMON = {
    "de": "der die das und in zu den mit von für auf ist im dem nicht ein eine als auch es an er sich des".split(),
    "en": "the of and to in a is that for it as was with be by on not he his but are this or had from".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce avec".split(),
}
WORDS = tuple(sorted({w for ws in COMMON.values() for w in ws}))
#: Digits count with lower-case letters: lists of numbers in clean prose are no sign of junk.
CLASSES = ("plain", "upper", "space", "punctuation", "symbol", "other")

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CHARS = 200
MIN_COMMON = 100
MIN_DOCS = 20
MAX_CHAR_DISTANCE = 0.14
MAX_WORD_DISTANCE = 0.45
#: Shares of a class are counted in thousandths for the median.
SHARES = 1000
#: Histograms add up as whole millionths, so references don't depend on the order of the sum.
UNIT = 1_000_000

#: Words of which a worker keeps what they hold, and their bytes: the memory bound of a cache, not of the result.
CACHE_WORDS = 1_000_000
CACHE_BYTES = 24 << 20

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


_SPACE, _SYMBOL = CLASSES.index("space"), CLASSES.index("symbol")


def _classes() -> np.ndarray:
    """The class of every code point of the basic plane; all others are ``other``."""
    out = np.full(1 << 16, CLASSES.index("other"), np.uint8)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))
        if chr(c) in SPACES:
            out[c] = _SPACE
        elif chr(c) in SYMBOLS:
            out[c] = _SYMBOL
        elif kind in ("Ll", "Lo", "Nd"):
            out[c] = 0
        elif kind == "Lu":
            out[c] = 1
        elif kind[0] == "P":
            out[c] = 3
    return out


_MARKS = SYMBOLS + ".,;:!?\"'()[]{}/\\-+=_~^`@"
_BLANK = bytes(32 if chr(c) in _MARKS else c for c in range(256))
_PLACE = {w.encode(): i for i, w in enumerate(WORDS)}


def _windows_of_three(words: np.ndarray) -> np.ndarray:
    """A number for each three neighbouring words, the same for the same words."""
    a, b, c = (words[j : words.size - 2 + j].astype(np.int64) for j in range(3))
    n = int(words.max()) + 1
    if n < 1 << 21:
        return (a * n + b) * n + c
    return np.unique(a * n + b, return_inverse=True)[1] * n + c


class Reader:
    """Counts and histograms of texts, batch by batch.  Of each word met it keeps how many words it is once marks
    are blanks, and which common words are among these."""

    def __init__(self):
        self.numbers = Numbers(CACHE_WORDS, CACHE_BYTES)
        self.classes = _classes()
        self.forget()

    def forget(self) -> None:
        self.sizes, self.common, self.several = np.zeros(0, np.int32), np.zeros(0, np.int16), np.zeros(0, bool)
        self.rest: dict[int, list[int]] = {}

    def learn(self, words: pa.Array) -> None:
        start, none = self.sizes.size, len(WORDS)
        bare = pc.ascii_trim(pc.ascii_lower(words), characters=_MARKS)
        sizes = pc.greater(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False).astype(np.int32)
        common = pc.index_in(bare, value_set=pa.array(WORDS)).fill_null(none).to_numpy(zero_copy_only=False).astype(np.int16)
        several = np.zeros(len(words), bool)
        apart = np.flatnonzero(pc.match_substring_regex(bare, "[" + re.escape(_MARKS) + "]").to_numpy(zero_copy_only=False))
        for i, w in zip(apart.tolist(), bare.take(pa.array(apart)).to_pylist()):  # words with marks inside
            parts = w.encode().translate(_BLANK).split()
            found = [_PLACE[x] for x in parts if x in _PLACE]
            sizes[i], common[i], several[i] = len(parts), found[0] if found else none, len(found) > 1
            if len(found) > 1:
                self.rest[start + i] = found[1:]
        self.sizes, self.common, self.several = (np.concatenate(x) for x in ((self.sizes, sizes), (self.common, common), (self.several, several)))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row for each text: (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), class counts, and
        common-word counts (the last: all other words)."""
        texts = text_of(texts)
        n, bins = len(texts), len(WORDS) + 1
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
        flat = lists.flatten()
        some = pc.greater(pc.binary_length(flat), 0)  # a text without words is split into one empty string
        doc = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))[some.to_numpy(zero_copy_only=False)]
        at, new, anew = self.numbers(flat.filter(some))
        if anew:
            self.forget()
        if len(new):
            self.learn(new)
        counts, by_class = np.zeros((n, 5), np.int64), np.zeros((n, len(CLASSES)), np.int64)
        counts[:, 0] = np.bincount(doc, minlength=n)
        if at.size > 2:
            window = _windows_of_three(at)
            window[doc[2:] != doc[:-2]] = -1
            order = np.argsort(window, kind="stable")  # equal windows stand in order of their texts
            w, d = window[order], doc[:-2][order]
            same = (w[1:] == w[:-1]) & (d[1:] == d[:-1]) & (w[1:] >= 0)
            often = np.zeros(at.size, bool)
            often[order[1:][same]] = often[order[:-1][same]] = True
            often[1:] |= often[:-1].copy()
            inside = often.copy()
            inside[1:] |= often[:-1]
            counts[:, 4] = np.bincount(doc[inside], minlength=n)
        for i, text in enumerate(texts.to_pylist()):
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            by_class[i] = np.bincount(self.classes[np.minimum(points, 0xFFFF)], minlength=len(CLASSES))
            lines = [x for x in text.split("\n") if x.strip(SPACES)]
            counts[i, 3] = len(lines) - len(set(lines))
        counts[:, 1] = by_class.sum(axis=1) - by_class[:, _SPACE]
        counts[:, 2] = by_class[:, _SYMBOL]
        by_word = np.bincount(doc * bins + self.common[at], minlength=n * bins).reshape(n, bins)
        for i in np.flatnonzero(self.several[at]).tolist():
            for k in self.rest[int(at[i])]:
                by_word[doc[i], k] += 1
        by_word[:, -1] = np.bincount(doc, self.sizes[at], n).astype(np.int64) - by_word[:, :-1].sum(axis=1)
        return counts, by_class, by_word


def distances(histograms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (base 2) of one histogram, or of each row of several, to the rows of references."""
    p = histograms / np.maximum(1, histograms.sum(axis=-1, keepdims=True))
    out = []
    with np.errstate(divide="ignore", invalid="ignore"):
        for q in references:
            m = (p + q) / 2
            left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
            right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
            out.append(np.sqrt(np.clip((left + right) / 2, 0, 1)))
    return np.stack(out, axis=-1)


def references(docs: DataFrame) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Histograms by language over all documents long enough: of classes (medians), of words (means).

    For each of at most five languages some hundred sums and 6 x 1001 counts come to the driver.
    """
    lang = F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise("other")
    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batches):
        reader = per_worker(("quality",), Reader)
        grids: dict[str, np.ndarray] = defaultdict(lambda: np.zeros((len(CLASSES), SHARES + 1), np.int64))
        words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(WORDS) + 2, np.int64))
        for b in batches:
            counts, by_class, by_word = reader(b.column(1))
            chars, total = by_class.sum(axis=1), by_word.sum(axis=1)
            langs = np.array(b.column(0).to_pylist(), object)
            for lang in set(langs.tolist()):
                mine = (langs == lang) & (counts[:, 0] >= MIN_WORDS)
                long = mine & (chars >= MIN_CHARS)
                for share in by_class[long] * SHARES // chars[long, None]:
                    grids[lang][np.arange(len(CLASSES)), share] += 1
                long = mine & (total >= MIN_COMMON)
                words[lang][:-1] += (by_word[long] * UNIT // total[long, None]).sum(axis=0)
                words[lang][-1] += long.sum()
        rows = [(lang, kind, i, int(x[i])) for kind, found in (("class", grids), ("word", words)) for lang, y in found.items() for x in [y.reshape(-1)] for i in np.flatnonzero(x).tolist()]
        columns = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    partial = to_python(docs).select(lang.alias("lang"), F.col("text").cast("binary").alias("text")).mapInArrow(releasing(run), "lang string, kind string, bin int, n long")
    class_refs, word_refs = {}, {}
    found: dict[tuple[str, str], dict[int, int]] = {}
    for r in partial.groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n")).collect():
        found.setdefault((r.lang, r.kind), {})[r.bin] = r.n
    for (lang, kind), bins in found.items():
        if kind == "word":
            h = np.array([bins.get(i, 0) for i in range(len(WORDS) + 2)], np.float64)
            if h[-1] >= MIN_DOCS:
                word_refs[lang] = h[:-1] / h[:-1].sum()
        else:
            grid = np.array([[bins.get(i * (SHARES + 1) + n, 0) for n in range(SHARES + 1)] for i in range(len(CLASSES))])
            if grid[0].sum() >= MIN_DOCS:
                median = (grid.cumsum(axis=1) * 2 >= grid.sum(axis=1, keepdims=True)).argmax(axis=1) + 0.5 * (grid[:, 0] * 2 < grid.sum(axis=1))
                class_refs[lang] = median / median.sum()
    return class_refs, word_refs


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the two
    distances (null where they aren't judged)."""
    return _judged(docs.select("doc_id", "text", "lang"), references(docs))


def _judged(docs: DataFrame, refs) -> DataFrame:
    class_refs, word_refs = (np.array([r[k] for k in sorted(r)]) for r in refs)
    schema = pa.schema([("doc_id", pa.int64()), *((c.split()[0], pa.int64()) for c in COUNTS.split(", ")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64())])

    def run(batches):
        reader = per_worker(("quality",), Reader)
        for b in batches:
            counts, failed, kept, far, words_far = verdicts(reader, b.column(1), class_refs, word_refs)
            columns = [b.column(0), *counts.T, failed, kept, far, words_far]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type, from_pandas=True) if isinstance(x, np.ndarray) else x for x, f in zip(columns, schema)], schema=schema)

    ddl = f"doc_id long, {COUNTS}, base_failed boolean, kept boolean, char_distance double, word_distance double"
    return to_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(releasing(run), ddl)


def verdicts(reader: Reader, texts: pa.Array, class_refs: np.ndarray, word_refs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts, whether the plain counts fail, whether the text is kept, and the distances (NaN where not judged)."""
    counts, by_class, by_word = reader(texts)
    failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
    far, words_far = (np.full(len(texts), np.nan) for _ in range(2))
    for out, histogram, refs, least in ((far, by_class, class_refs, MIN_CHARS), (words_far, by_word, word_refs, MIN_COMMON)):
        long = histogram.sum(axis=1) >= least
        if len(refs) and long.any():
            out[long] = distances(histogram[long], refs).min(axis=1)
    return counts, failed, ~failed & ~(far > MAX_CHAR_DISTANCE) & ~(words_far > MAX_WORD_DISTANCE), far, words_far


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged.  A row's verdict is a function of its text, so it is
    taken in place and no join is needed."""
    class_refs, word_refs = (np.array([r[k] for k in sorted(r)]) for r in references(docs))

    @releasing
    def run(batches):
        reader = per_worker(("quality",), Reader)
        for texts in batches:
            yield pd.Series(verdicts(reader, pa.array(texts, pa.binary()), class_refs, word_refs)[2])

    @F.pandas_udf("boolean")
    def passes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(batches)

    return to_python(docs).where(passes(F.col("text").cast("binary")))


def op2_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
