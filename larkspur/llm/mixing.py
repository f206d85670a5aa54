"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is water-filled: ``min(cap * size, level * weight)``, the fixed point of resharing
the excess by weight. Each document is taken ``floor(target / size)`` times whole (complete epochs);
the rest of the budget goes to the documents with the smallest exponential keys ``-ln(u) / quality``,
in order, up to the budget. The document on the boundary gives only the words that are left, so a
source's words differ from its target by rounding alone.

The order within a source is never one task's work: keys fall into BUCKETS equal-probability buckets,
sizes are summed by (source, bucket) before any shuffle, and only the one bucket of a source that
holds the boundary is sorted.

Defined cases: null text has size 0 and is never taken; null source is a source, last in order; an
empty source or table has target 0 or no rows; repeated rows are separate documents with equal keys
(the same rows get the same words in sum, in some order); a quality that is null, not finite or below
0.01 counts as 0.01; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import materialize, n_words, tune

BUCKETS = 4096
WEIGHTS = (5.0, 2.0, 1.0)


def text_quality(text: Column) -> Column:
    """Share of characters that are not symbols, squared: 1 for prose, less for junk."""
    n = F.length(text)
    return F.when(n > 0, F.pow(F.length(F.translate(text, "!#$%&*@^~|<>{}[]=+_\\", "")) / n, F.lit(2.0))).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row per source in one window.

    Sorted by ratio of cap to weight, sources are capped up to the first whose cap lies above the
    water level of what is left; running sums give that level for every prefix.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = (
        sizes.withColumn("weight", F.element_at(w, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
        .withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    )
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # the level of the first source, by ratio, that is not capped
    t = t.withColumn("level", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("level") * F.col("weight")))
    return t.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, quality: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``; columns named in ``keep`` follow.

    ``keep`` must not name one of the result's columns. Reruns agree: keys hash doc_id and source.
    """
    tune(docs.sparkSession)
    q = F.col("text") if quality is None else quality
    q = (text_quality(q) if quality is None else q).cast("double")
    u = (F.pmod(F.xxhash64("doc_id", "source", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    base = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), q.alias("q"), *keep)
    base = base.withColumn("q", F.when(F.isnan("q") | F.col("q").isNull() | (F.col("q") < 0.01) | (F.col("q") > 1e6), F.lit(0.01)).otherwise(F.col("q")))
    base = base.withColumn("key", -F.log(u) / F.col("q")).drop("q")
    # any monotone map of the key will do; this one spreads exponential keys evenly
    base = base.withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor(F.lit(BUCKETS) * (1 - F.exp(-F.col("key"))))).cast("int"))
    base = materialize(base, "mix")

    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    sizes = sums.groupBy("source").agg(F.sum("in_bucket").alias("source_size"))
    plan = source_targets(sizes, weights, share, cap)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = materialize(plan, "mix-plan")

    # where each source's budget ends: the first bucket whose running sum passes it
    running = Window.partitionBy("source").orderBy("bucket")
    ends = (
        sums.withColumn("upto", F.sum("in_bucket").over(running))
        .join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("in_bucket") <= F.col("budget")))
        .select(F.col("source").alias("e"), F.col("bucket").alias("last"), (F.col("budget") - (F.col("upto") - F.col("in_bucket"))).alias("left"))
    )
    plan = materialize(plan.join(ends, F.col("source").eqNullSafe(F.col("e")), "left").select(F.col("source").alias("s"), "source_size", "target", "epochs", F.coalesce("last", F.lit(BUCKETS)).alias("last"), F.coalesce("left", F.lit(0)).alias("left")), "mix-plan")

    rows = base.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.col("epochs") * F.col("size")
    out = ["doc_id", "size", "source_size", "target", "taken", *keep]
    clear = rows.where(F.col("bucket") != F.col("last")).withColumn("taken", whole + F.when(F.col("bucket") < F.col("last"), F.col("size")).otherwise(0)).select(*out)
    inside = Window.partitionBy("source").orderBy("key", F.col("doc_id").isNull(), "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(F.col("bucket") == F.col("last")).withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    edge = edge.withColumn("taken", whole + F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before")))).select(*out)
    return clear.unionByName(edge)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, as often as they are taken.

    A document that gives only a part of its words (one a source) comes last cut after that many words,
    its n_chars (if there) the new length.
    """
    rows = docs.select("doc_id", "source", "text", F.struct("*").alias("row"))
    got = mix(rows, keep=("row",), **options).where("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    left = F.col("taken") - whole * F.col("size")
    words = F.explode(F.concat(F.array_repeat(F.col("size"), whole), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<bigint>"))))
    got = got.select("row", "size", words.alias("words"))
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = dict(zip(names, b.column("row").flatten(), strict=True))
            new = [first_words(t, n) for t, n in zip(fields["text"].to_pylist(), b.column("words").to_pylist(), strict=True)]
            fields["text"] = pa.array(new, pa.string())
            if "n_chars" in fields:
                fields["n_chars"] = pa.array([len(t) for t in new], pa.int64()).cast(fields["n_chars"].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(list(fields.values()), list(fields))], ["row"])

    part = got.where("words < size").select("row", "words").mapInArrow(cut, T.StructType([T.StructField("row", got.schema["row"].dataType)]))
    return got.where("words = size").select("row").union(part).select("row.*")


def first_words(text: str, n: int) -> str:
    """``text`` up to the end of its n-th word."""
    if n <= 0:
        return ""
    for k, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text), 1):
        if k == n:
            return text[: m.end()]
    return text
