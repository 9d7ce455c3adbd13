"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas: an insert adds one document
and its tokens, a delete takes them off, a revision takes off the old count and adds the new one.  A batch
of deltas is pre-aggregated to one row a group and committed as one folder of the store, named by the
batch's id.  It is written aside and renamed into place, so a batch shows whole or not at all and one that broke
off can be run again; committing it again changes nothing, and with other deltas is an error.  Totals are the sum over the
committed batches, so order doesn't matter, and ``compact`` folds many batches into one.

Defined results: a null text has 0 tokens and counts as a document; null source or language are groups of
their own; repeated rows count each; extra columns are ignored; an empty batch commits and adds
nothing; groups whose documents and tokens are all taken back are left out of ``totals``.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, exists, hadoop_path, materialized, per_worker, shared_path, table, to_python
from .token_file import Encoder

KEYS = ("source", "lang", "tokenizer_version")
DDL = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"

#: Bytes that are no letter, digit or part of a character beyond ASCII.
_BREAKS = bytes(c for c in range(128) if not chr(c).isalnum())
_MARKS = bytes(c for c in _BREAKS if 32 < c < 127)
_SPACED = bytes(32 if c in _BREAKS else c for c in range(256))
_NO_MARKS = bytes(c for c in range(256) if c not in _MARKS)
SYMBOLS = b"#*$%&|<>"
_BARE = bytes(32 if c in SYMBOLS else c for c in range(256))


def words(text: bytes) -> int:
    """Runs without white space."""
    return len(text.split())


def runs(text: bytes) -> int:
    """Runs of letters and digits (all characters beyond ASCII among them), and every ASCII mark."""
    return len(text.translate(_SPACED).split()) + len(text.translate(None, _NO_MARKS))


def bare(text: bytes) -> bytes:
    """The text with its symbols blanked."""
    return text.translate(_BARE)


class Tokens:
    """Counts the tokens of a tokenizer file, many texts at a time."""

    def __init__(self, path: str):
        self.path = path

    def many(self, texts: list[bytes]) -> list[int]:
        kept = per_worker(("rollup",), dict)  # the encoders of all versions that count in this worker
        if self.path not in kept:
            kept[self.path] = Encoder(self.path)
        return [ids.size for ids in kept[self.path].arrays(pa.array(texts, pa.binary()))]

    def __call__(self, text: bytes) -> int:
        return self.many([text])[0]


#: Tokenizer versions: from a UTF-8 text to its number of tokens.
VERSIONS = {"words-1": words, "runs-1": runs}


def counted(docs: DataFrame, versions: dict[str, Callable[[bytes], int]] = VERSIONS, change: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens and changed_tokens (of ``change(text)``): a row for
    each document and version.  Texts are read once.  A version is a function of one text, or has ``many`` for a
    list of them."""
    counters = list(versions.values())

    @F.pandas_udf("array<long>")
    def count(texts: pd.Series) -> pd.Series:
        mine = [t or b"" for t in texts]
        other = [change(t) for t in mine] if change else mine
        columns = [f.many(ts) if hasattr(f, "many") else [f(t) for t in ts] for ts in (mine, other) for f in counters]
        return pd.Series([list(row) for row in zip(*columns)], dtype=object)

    rows = to_python(docs).select("doc_id", "source", "lang", count(F.col("text").cast("binary")).alias("n"))
    n = len(counters)
    parts = [F.struct(F.lit(v).alias("v"), F.get("n", F.lit(i)).alias("a"), F.get("n", F.lit(n + i)).alias("b")) for i, v in enumerate(versions)]
    rows = rows.select("doc_id", "source", "lang", F.explode(F.array(*parts)).alias("p"))
    return rows.select("doc_id", "source", "lang", F.col("p.v").alias("tokenizer_version"), F.col("p.a").alias("n_tokens"), F.col("p.b").alias("changed_tokens"))


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").cast("long").alias("n_tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).cast("long").alias("n_tokens"))


def revisions(rows: DataFrame) -> DataFrame:
    """``rows`` with old_tokens and new_tokens: the documents stay, their counts change."""
    return rows.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), (F.col("new_tokens") - F.col("old_tokens")).cast("long").alias("n_tokens"))


class Rollup:
    """Totals kept in a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, batch: str) -> str:
        return f"{self.path}/batch-{hashlib.sha256(batch.encode()).hexdigest()[:32]}"

    def committed(self, batch: str) -> bool:
        return batch in self._batches()[1]

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch of deltas (KEYS, n_docs, n_tokens) once; False if it is in already, and an error if it is in
        with other deltas.

        The sums are written aside and renamed into place, which at most one of several writers can do.
        """
        sums = self._sums(deltas)
        aside = f"{self.path}/writing-{uuid.uuid4().hex}"
        sums.write.parquet(aside)
        # One row a group: the sum of its rows' hashes tells one content from another.
        mark = self.spark.read.schema(DDL).parquet(aside).agg(F.sum(F.xxhash64(*KEYS, "n_docs", "n_tokens").cast("decimal(38,0)")).alias("h")).first().h
        fs, folder = hadoop_path(self.spark, self._folder(batch))
        path = hadoop_path(self.spark, aside)[1]
        self._note(path, {batch: str(mark)})
        known = self._batches()[1].get(batch)
        if known is None:
            done = hadoop_path(self.spark, f"{self._folder(batch)}/_SUCCESS")[1]
            if fs.exists(folder) and not fs.exists(done):
                fs.delete(folder, True)
            if not fs.exists(folder):
                fs.rename(path, folder)
                inside = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, path.getName())
                if fs.exists(inside):  # another writer was first, and the rename put this one into its folder
                    fs.delete(inside, True)
                elif not fs.exists(path):
                    return True
            known = self._batches()[1].get(batch)
        fs.delete(path, True)
        if known != str(mark):
            raise ValueError(f"batch {batch!r} is committed with other deltas")
        return False

    def _note(self, folder, marks: dict[str, str]) -> None:
        """Write down which batches a folder holds, and the marks of their contents."""
        fs, _ = hadoop_path(self.spark, self.path)
        out = fs.create(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "_batches"))
        try:
            out.write(bytearray(json.dumps(marks).encode()))
        finally:
            out.close()

    def _batches(self) -> tuple[list[str], dict[str, str]]:
        """The folders that count, and the marks of all batches committed.  Once a compacted folder stands, those it
        holds no longer count, deleted or not."""
        fs, p = hadoop_path(self.spark, self.path)
        if not fs.exists(p):
            return [], {}
        jvm = self.spark.sparkContext._jvm
        found = {}
        for status in fs.listStatus(p):
            name = status.getPath().getName()
            if name.startswith(("batch-", "compact-")) and exists(self.spark, f"{self.path}/{name}/_SUCCESS"):
                stream = fs.open(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_batches"))
                try:
                    found[name] = json.loads(bytes(stream.readAllBytes()))
                finally:
                    stream.close()
        # The larger of two folders that hold the same batch stands for both.
        order = sorted(found, key=lambda n: (-len(found[n]), n))
        counted, marks = [], {}
        for name in order:
            if not found[name].keys() <= marks.keys():
                counted.append(f"{self.path}/{name}")
                marks |= found[name]
        return sorted(counted), marks

    def compact(self) -> int:
        """Fold all committed batches into one folder; returns how many folders it stands for.

        It is written aside and renamed like a batch.  From then on the folders it holds don't count, so breaking off
        before they are deleted changes no total.  One process compacts at a time; commits may go on meanwhile.
        """
        folders, marks = self._batches()
        if len(folders) < 2:
            return 0
        aside = f"{self.path}/writing-{uuid.uuid4().hex}"
        self._sums(self.spark.read.schema(DDL).parquet(*folders)).write.parquet(aside)
        fs, path = hadoop_path(self.spark, aside)
        self._note(path, marks)
        fs.rename(path, hadoop_path(self.spark, f"{self.path}/compact-{uuid.uuid4().hex}")[1])
        for f in folders:
            discard(self.spark, f)
        return len(folders)

    @staticmethod
    def _sums(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        folders, _ = self._batches()
        rows = self.spark.read.schema(DDL).parquet(*folders) if folders else self.spark.createDataFrame([], DDL)
        return self._sums(rows)


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four commits over all documents: every document enters under both tokenizer versions; those labelled
    toxic are taken out; those labelled of low quality are revised to their count without symbols; and
    the take-down arrives a second time, which changes nothing."""
    docs = table(spark, sf_dir, "documents")
    # What is joined and summed from here on are a few numbers a document.
    counts, _ = materialized(counted(docs, change=bare), "counts")
    labels = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy(F.col("doc_id").alias("_id"))
    labels = labels.agg(F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"), F.max((F.col("quality") == 0).cast("int")).alias("_low"))
    known = counts.join(labels, F.col("doc_id") == F.col("_id"))
    gone = known.where("_toxic = 1")
    revised = known.where("_low = 1 and coalesce(_toxic, 0) = 0").withColumnsRenamed({"n_tokens": "old_tokens", "changed_tokens": "new_tokens"})
    rollup = Rollup(spark, shared_path(spark, "rollup"))
    rollup.commit("ingest", inserts(counts))
    rollup.commit("take-down", deletes(gone))
    rollup.commit("revision", revisions(revised))
    rollup.commit("take-down", deletes(gone))
    return rollup.totals()


OP10_SQL = r"""
WITH l AS (SELECT doc_id, bool_or(toxic = 1) AS toxic, bool_or(quality = 0) AS low FROM labels GROUP BY doc_id),
d AS (
  SELECT d.source, d.lang,
         CASE WHEN coalesce(l.low, false) THEN regexp_replace(d.text, '[#*$%&|<>]', ' ', 'g') ELSE d.text END AS t
  FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id WHERE NOT coalesce(l.toxic, false)),
c AS (
  SELECT source, lang, 'words-1' AS tokenizer_version, coalesce(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')), 0) AS n FROM d
  UNION ALL
  SELECT source, lang, 'runs-1', coalesce(len(regexp_extract_all(t, '[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]')), 0) FROM d)
SELECT source, lang, tokenizer_version, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM c GROUP BY ALL
"""
