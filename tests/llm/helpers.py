"""Small document tables for the tests of all operators."""

from __future__ import annotations

import random

import pyarrow as pa

WORDS = "stone river cloud lamp green quick seven paper glass horn mile salt tower wheel ember frost".split()


def prose(rng: random.Random, n: int, line: int = 9) -> str:
    words = [rng.choice(WORDS) + rng.choice(["", "s", "er", "ing", "ly"]) for _ in range(n)]
    return "\n".join(" ".join(words[a : a + line]) for a in range(0, n, line))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Rows (doc_id, text, lang, source, n_chars) with copies, near copies, shared passages and odd texts."""
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randint(5, 220)) for _ in range(n)]
    passage = prose(rng, 70)
    for i in range(0, n, 6):
        texts[i] = f"{texts[i]} {passage}\n{prose(rng, 20)}"
    for i in range(5, n, 10):
        texts[i] = texts[i - 5]
    for i in range(7, n, 10):
        words = texts[i - 3].split(" ")
        words[len(words) // 2] = "changed"
        texts[i] = " ".join(words)
    texts += [None, "", "   \n\t ", "one", "Two words", "x" * 400, "ab" * 300, "é ß 日本 😀 \x00", "la " * 900, "\r\n".join(["same line of this document here"] * 4), prose(rng, 6000)]
    sources = ["b", "a", None, "ü", "c"]
    return [(i * 3, t, "en" if i % 4 else None, sources[min(i % 7, 4)], None if t is None else len(t)) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows: list[tuple], parts: int = 3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def odd_tables(spark) -> dict:
    """Empty, null ids, repeated rows and ids, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    some = corpus(2, 12)
    repeated = some + some[:4] + [(0, "another text under a repeated id", "en", "a", 5)]
    nulls = [(None, t, l, s, n) for _, t, l, s, n in some[:6]] + some[6:] + [(None, None, None, None, None)]
    extra = table(spark, some)
    for name in ("size", "doc", "th", "row", "key", "bucket", "taken", "score", "fp", "line", "h"):
        extra = extra.withColumn(name, F.lit(name))
    return {"empty": table(spark, []), "repeated": table(spark, repeated), "nulls": table(spark, nulls), "extra": extra}


def rows_of(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


__all__ = ["SCHEMA", "corpus", "odd_tables", "pa", "prose", "rows_of", "table"]
