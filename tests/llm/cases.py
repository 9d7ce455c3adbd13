"""Documents for the small tests: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

SYLLABLES = "an ble ed en er es ha he in ing ly nd nt on or ou re sh st th ti tion wh".split()
WORDS = "the of and to in is with for that was on by".split()


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(WORDS) if rng.random() < 0.35 else "".join(rng.choices(SYLLABLES, k=rng.randint(2, 3))) for _ in range(n)]
    out = []
    for i, w in enumerate(words):
        first = i == 0 or out[-1].endswith((".", ".\n"))
        out.append((w.capitalize() if first else w) + ("." if rng.random() < 0.1 else "," if rng.random() < 0.1 else ""))
    return " ".join(out)


def documents(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(60, 200)), "en", f"s{i % 4}", 0) for i in range(n)]
    long = prose(rng, 30_000)
    rows += [
        (n, None, None, None, None),
        (n + 1, "", "en", "s0", 0),
        (n + 2, " \t\n\x0b\x0c\r", "xx", "", 0),
        (n + 3, long, "en", "s1", 0),
        (n + 4, rows[3][1], "en", "s2", 0),
        rows[5],
        rows[5],
        (None, "no id at all " + prose(rng, 70), "en", "s3", 0),
        (None, None, "en", None, 0),
        (n + 5, "Ünïcödé ß 日本語  wide space 𝒜 " + prose(rng, 70), "de", "s3", 0),
        (n + 6, "x" * 40_000, "en", "s0", 0),
        (n + 7, "one two three", "en", "s0", 0),
    ]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def clashing(df):
    """The same documents with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ["key", "fp", "size", "row", "_id", "n", "kept", "component_id", "target", "bucket", "upto", "rule", "word_distance", "a.b", "_key", "node", "root"]
    return df.select("*", *[F.lit(f"mine {n}").alias(n) for n in names])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
