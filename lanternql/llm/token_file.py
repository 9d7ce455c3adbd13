"""Token ids in a binary format: one concatenated id array and Elias-Fano encoded document boundaries.

A file set is a table of segments, each a run of documents in ascending doc_id order:

``part, number, before``  which task wrote it, its place there, and the ids of that task before it
``n_docs, n_ids``  what the segment holds
``ids``     the ids of its documents one after the other, little-endian, 16 bits each if the vocabulary
            allows it, else 32
``low, high, marks``  the ends of its documents in ``ids`` as an Elias-Fano sequence: the low bits packed,
            the high parts in unary, and the position of every 64th one in it, from which ``select``
            finds any boundary without a table of 64-bit offsets
``names``   the doc_ids

Segments are rows of a Parquet table, so any store that Spark writes to will do, tasks that are lost are
run again, and a job's output shows only when it is committed.  ``export`` writes plain files instead.

Documents are dealt by ranges of (doc_id, hash of the text), so repeated ids spread; ties are ordered by
text.  A segment holds about ``SEGMENT_IDS`` ids, whole documents only, so a task's memory is bounded by that
and by its longest document.

Defined results: a null text is empty and gives the end id alone; a null doc_id comes first and is kept
as null; repeated rows are written each; extra columns are ignored; an empty table gives an empty file set.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Numbers, per_worker, releasing, shared_path, table, text_of, to_python

END = 0
SEGMENT_IDS = 1 << 20
STEP = 64
#: Strings whose ids a worker keeps, and their bytes: the memory bound of a cache, not of the result.
CACHE_STRINGS = 1_000_000
CACHE_BYTES = 24 << 20

#: Characters whose classes are spelled out in PIECES; texts with any other go to the library whole.
PLAIN = r"\n\x20-\x7e\xa1-\xac\xae-\xffĀ-ſ‐-‧‰-›€"
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
#: Marks that plain texts don't hold: the start of a text, the end of a chunk, and what stands between pieces.
_FIRST, _STOP, _BETWEEN = "\x01", "\x00", "\x02"
#: How a byte-level BPE vocabulary of this kind splits such texts before merging; white space at a text's end is followed
#: by the mark alone.
PIECES = rf"{_STOP}| ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBER}]+| ?[^\s{_STOP}{_LETTER}{_NUMBER}]+|\s+(?![^\s{_STOP}])|\s+"


def _byte_names() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 ones for themselves,
    the others in order from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_NAMES = _byte_names()


def _ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if ends.size else 0
    at = np.repeat((starts - (ends - sizes)).astype(np.int32 if max(total, flat.size) < 1 << 31 else np.int64), sizes)
    at += np.arange(total, dtype=at.dtype)
    return flat[at]


class Kept:
    """Ids of strings; those not met before are encoded all at once.  A million strings take some 40 MB."""

    def __init__(self, encode, kind: str):
        self.encode, self.kind = encode, kind
        self.numbers = Numbers(CACHE_STRINGS, CACHE_BYTES)
        self.forget()

    def forget(self) -> None:
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, self.kind)

    def __call__(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each string has, and all ids one after the other."""
        at, new, anew = self.numbers(strings)
        if anew:
            self.forget()
        if len(new):
            sizes, ids = self.encode(new)
            self.starts = np.concatenate((self.starts, self.ids.size + np.cumsum(sizes, dtype=np.int64) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes.astype(np.int32)))
            self.ids = np.concatenate((self.ids, ids))
        return self.sizes[at], _ragged(self.ids, self.starts[at], self.sizes[at])


class Encoder:
    """Encodes texts with a tokenizer file.

    Byte-level BPE splits a text into pieces and merges inside each piece alone, and a space between two other
    characters than white space always begins a piece.  So the ids of a plain text are those of its chunks between
    such spaces, one after the other, and a chunk's those of its pieces; the library merges each piece that hasn't
    been met.  Texts with characters beyond PLAIN, and all texts of other kinds of tokenizers, go to the library whole.
    """

    def __init__(self, path: str):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        before, model = parts["pre_tokenizer"] or {}, parts["model"]
        self.by_chunks = (
            not any(parts[k] for k in ("normalizer", "truncation", "padding")) and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)
            and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        )
        #: What marks a text that isn't plain: another character, or a token that is never split.
        special = [re.escape(t["content"]) for t in parts["added_tokens"]]
        self.odd = "|".join([f"[^{PLAIN}]", *special])
        self.split = re.compile(PIECES).findall
        self.spaces = re.compile(r"(?<=\S) (?=\S)").split
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.merge = self.tokenizer.model.tokenize
        self.pieces = Kept(self._pieces, self.kind)
        self.chunks = Kept(self._chunks, self.kind)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        stop, merge = _BYTE_NAMES[ord(_STOP)], self.merge
        sizes, ids = np.zeros(len(pieces), np.int32), [np.zeros(0, self.kind)]
        for at in range(0, len(pieces), 1 << 14):
            names = _BETWEEN.join(pieces.slice(at, 1 << 14).to_pylist()).encode().decode("latin-1").translate(_BYTE_NAMES)
            some: list[int] = []
            for i, p in enumerate(names.split(_BYTE_NAMES[ord(_BETWEEN)]), at):
                if p != stop:
                    got = merge(p)
                    sizes[i] = len(got)
                    some += [t.id for t in got]
            ids.append(np.array(some, self.kind))
        return sizes, np.concatenate(ids)

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # A word is a piece with the space before it; other chunks are split together, each followed by a mark.
        alpha = pc.utf8_is_alpha(chunks)
        word = alpha.to_numpy(zero_copy_only=False)
        texts = [c[1:] + _STOP if c[:1] == _FIRST else " " + c + _STOP for c in chunks.filter(pc.invert(alpha)).to_pylist()]
        column = pa.concat_arrays([pc.binary_join_element_wise(" ", chunks.filter(alpha), ""), pa.array(self.split("".join(texts)), pa.string())])
        sizes, ids = self.pieces(column)
        words = word.sum()
        last = np.flatnonzero(pc.equal(column, _STOP).to_numpy(zero_copy_only=False))
        upto = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        starts, ends = np.empty(word.size, np.int64), np.empty(word.size, np.int64)
        starts[word], ends[word] = upto[:words], upto[1 : words + 1]
        starts[~word], ends[~word] = np.concatenate(([upto[words]], upto[last + 1]))[: last.size], upto[last + 1]
        return ends - starts, _ragged(ids, starts, ends - starts)

    def arrays(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, as the library gives them for the whole text."""
        texts = text_of(texts)
        if not self.by_chunks:
            return self.whole(texts.to_pylist())
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        at = np.flatnonzero(odd)
        for i, ids in zip(at.tolist(), self.whole(texts.take(pa.array(at)).to_pylist())):
            out[i] = ids
        uneven = pc.match_substring_regex(texts, "  | \n|\n ").to_numpy(zero_copy_only=False) & ~odd
        for some, mine in ((texts.filter(pa.array(~odd & ~uneven)), ~odd & ~uneven), (texts.filter(pa.array(uneven)), uneven)):
            if not len(some):
                continue
            marked = pc.binary_join_element_wise(_FIRST, some, "")
            # Where white space comes in runs, only spaces between other characters part chunks.
            lists = pa.array([self.spaces(t) for t in marked.to_pylist()], pa.list_(pa.string())) if mine is uneven else pc.split_pattern(marked, " ")
            sizes, ids = self.chunks(lists.flatten())
            offsets = lists.offsets.to_numpy()
            ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[offsets - offsets[0]].tolist()
            for i, a, z in zip(np.flatnonzero(mine).tolist(), ends, ends[1:]):
                out[i] = ids[a:z]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [ids.tobytes() for ids in self.arrays(pa.array(texts, pa.string()))]


def elias_fano(ends: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Ascending non-negative integers -> (bits of the low part, low, high, marks)."""
    n, top = ends.size, int(ends[-1]) if ends.size else 0
    width = max(0, (top // n).bit_length() - 1) if n else 0
    ends = ends.astype(np.uint64)
    low = b""
    if width:
        bits = ((ends[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.reshape(-1), bitorder="little").tobytes()
    ones = (ends >> np.uint64(width)).astype(np.int64) + np.arange(n)
    unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    unary[ones] = 1
    return width, low, np.packbits(unary, bitorder="little").tobytes(), ones[::STEP].astype("<u4").tobytes()


def _bits() -> np.ndarray:
    """The place of the k-th set bit of each byte."""
    out = np.zeros((256, 8), np.int64)
    for byte in range(256):
        ones = [j for j in range(8) if byte >> j & 1]
        out[byte, : len(ones)] = ones
    return out


_BIT = _bits()


class Boundaries:
    """The Elias-Fano sequence as read back: ``select(i)`` gives the i-th value, ``selects`` those at many places, and
    ``all()`` decodes it without the marks."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, marks: bytes):
        self.n, self.width, self.low, self.high = n, width, low, high
        self.marks = np.frombuffer(marks, "<u4")

    def selects(self, at: np.ndarray) -> np.ndarray:
        """The values at these places: from the mark before each on, whole bytes are passed over until the one that
        holds its bit, all places in step; a mark is at most ``STEP`` bits before."""
        if at.size and not (0 <= int(at.min()) and int(at.max()) < self.n):
            raise IndexError(at)
        high = np.frombuffer(self.high, np.uint8)
        begin = self.marks[at // STEP].astype(np.int64)
        left = at % STEP
        byte = begin // 8
        here = high[byte] & (0xFF << (begin % 8) & 0xFF).astype(np.uint8)
        going = np.flatnonzero(left >= np.bitwise_count(here))
        while going.size:
            left[going] -= np.bitwise_count(here[going])
            byte[going] += 1
            here[going] = high[byte[going]]
            going = going[left[going] >= np.bitwise_count(here[going])]
        ones = byte * 8 + _BIT[here, left]
        return ((ones - at) << self.width) | self._lows(at)

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(at.size, np.int64)
        places = at[:, None] * self.width + np.arange(self.width)
        bits = np.frombuffer(self.low, np.uint8)[places >> 3] >> (places & 7) & 1
        return (bits.astype(np.int64) << np.arange(self.width)).sum(axis=1)

    def select(self, i: int) -> int:
        return int(self.selects(np.array([i], np.int64))[0])

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        if not self.width:
            return high.astype(np.int64)
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.width].reshape(self.n, self.width)
        return (high + (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)).astype(np.int64)


SEGMENT = pa.schema(
    [("part", pa.int32()), ("number", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("bytes_per_id", pa.int32()), ("ids", pa.binary()), ("width", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("marks", pa.binary()), ("names", pa.list_(pa.int64()))]
)
SEGMENT_DDL = "part int, number int, before long, n_docs long, n_ids long, bytes_per_id int, ids binary, width int, low binary, high binary, marks binary, names array<long>"


def write(docs: DataFrame, tokenizer_path: str, path: str, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every document and write the file set at ``path``."""

    def run(batches):
        from pyspark import TaskContext

        encode = per_worker(("encoder", tokenizer_path), lambda: Encoder(tokenizer_path))
        size, end = int(encode.kind[2]), np.array([END], encode.kind).tobytes()
        part, number = TaskContext.get().partitionId(), 0
        names: list = []
        arrays: list[bytes] = []
        held = before = 0

        def segment():
            nonlocal names, arrays, held, number, before
            ends = np.cumsum([len(a) // size for a in arrays])
            width, low, high, marks = elias_fano(ends)
            row = [part, number, before, len(names), held, size, b"".join(arrays), width, low, high, marks, names]
            names, arrays, before, held, number = [], [], before + held, 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, SEGMENT)], schema=SEGMENT)

        for b in batches:
            for name, ids in zip(b.column(0).to_pylist(), encode.arrays(b.column(1))):
                arrays.append(ids.tobytes() + end)
                names.append(name)
                held += ids.size + 1
                if held >= segment_ids:
                    yield segment()
        if names:
            yield segment()

    rows = to_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h").asc_nulls_first()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    rows.select("doc_id", "text").mapInArrow(releasing(run), SEGMENT_DDL).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a file set, decoded: doc_id, start, n_tokens, ids_crc32."""
    segments = spark.read.schema(SEGMENT_DDL).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    base = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("part").alias("p"), F.coalesce(base, F.lit(0)).cast("long").alias("base"))
    # One row of two numbers for each task of the writing job: a small side whatever the segments hold.
    rows = segments.join(F.broadcast(parts), F.col("part") == F.col("p")).withColumn("base", F.col("base") + F.col("before"))
    columns = ["base", "n_docs", "bytes_per_id", "ids", "width", "low", "high", "marks", "names"]

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{r['bytes_per_id']}")
                ends = Boundaries(r["n_docs"], r["width"], r["low"], r["high"], r["marks"]).selects(np.arange(r["n_docs"]))
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                wide = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(wide[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["names"], pa.int64()), pa.array(starts + r["base"]), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return rows.select(*columns).mapInArrow(releasing(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(spark: SparkSession, path: str, folder: str) -> None:
    """Write a file set as plain files ``<n>.ids`` and ``<n>.ef`` into a folder of the driver's machine,
    one segment at a time."""
    import json
    import os

    segments = spark.read.schema(SEGMENT_DDL).parquet(path).orderBy("part", "number")
    for i, r in enumerate(segments.toLocalIterator()):
        with open(os.path.join(folder, f"{i:08d}.ids"), "wb") as f:
            f.write(r.ids)
        head = {k: r[k] for k in ("n_docs", "n_ids", "bytes_per_id", "width", "names")} | {k: len(r[k]) for k in ("low", "high", "marks")}
        with open(os.path.join(folder, f"{i:08d}.ef"), "wb") as f:
            f.write(json.dumps(head).encode() + b"\n" + r.low + r.high + r.marks)


def op6_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "token-file")
    write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read(spark, path)
