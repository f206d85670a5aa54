"""Recall, latency statistics, epochs, and small placement rules of a search service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): share of the k true neighbours that were found."""
    hits = truth.where(F.col("rank") <= k).join(found.where(F.col("rank") <= k).select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left")
    return hits.groupBy("qid").agg((F.count("hit") / F.lit(float(k))).alias("recall"))


def latency_stats(samples: DataFrame, value: Column) -> DataFrame:
    """Mean and linearly interpolated p50, p95, p99 of the values that are not null, and how many are missing."""
    return samples.select(value.alias("v")).agg(
        F.count("v").alias("n"),
        F.count_if(F.col("v").isNull()).alias("failed"),
        F.avg("v").alias("mean"),
        *(F.percentile("v", F.lit(p / 100)).alias(f"p{p}") for p in (50, 95, 99)),
    )


def epoch_rows(vectors: DataFrame, epoch: int, size: int) -> DataFrame:
    """The rows that have arrived by the end of an epoch."""
    return vectors.where(F.col("vec_id") < (epoch + 1) * size)


def chunks(keys: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """(group, key, chunk): the keys of a group in order, at most ``most`` a chunk, no chunk shared by groups."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1
    return keys.select(group, key, F.floor(place / most).cast("long").alias("chunk"))


def placed_chunks(keys: DataFrame, group: str, key: str, most: int, places: int) -> DataFrame:
    """(group, key, place): each chunk of ``chunks`` at a place of its own, in order of group; ValueError if there are too few places.

    Groups are the partitions of an index, which are few by design, so their chunks are numbered in one window.
    """
    cut = chunks(keys, group, key, most)
    sizes = cut.groupBy(group).agg((F.max("chunk") + 1).alias("n"))
    first = sizes.withColumn("first", F.sum("n").over(Window.orderBy(group)) - F.col("n"))
    needed = sizes.agg(F.sum("n")).first()[0] or 0
    if needed > places:
        raise ValueError(f"{needed} places are needed and there are {places}")
    return cut.join(F.broadcast(first), group).select(group, key, (F.col("first") + F.col("chunk")).alias("place"))


def hash_route(key: Column, n: int) -> Column:
    """A sticky, even assignment of strings to n places."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def cache_misses(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    return wanted.join(cached.select(key), key, "left_anti")


def cached_first(wanted: DataFrame, placed: DataFrame, key: str, n: int) -> DataFrame:
    """Each wanted key's place: the one it is cached at, else its hash route (negative, so they differ)."""
    both = wanted.join(placed.select(key, "place"), key, "left")
    return both.select(key, F.coalesce(F.col("place"), -1 - hash_route(F.col(key), n)).cast("int").alias("place"))


def query_results(found: DataFrame) -> DataFrame:
    """(query_index, results): one row a query, its neighbours in order, as a results file holds them."""
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").cast("string").alias("id"), "distance")))
    return found.groupBy(F.col("qid").alias("query_index")).agg(F.transform(rows, lambda r: F.struct(r["id"].alias("id"), r["distance"].alias("distance"))).alias("results"))


def iso_utc(seconds: Column) -> Column:
    """Seconds since 1970 as ISO text in UTC, whatever the session's time zone; microseconds only where there are any."""
    micros = F.round(seconds * 1_000_000).cast("long")
    day = F.make_dt_interval(F.floor(micros / 86_400_000_000).cast("int"), F.lit(0), F.lit(0), (F.pmod(micros, F.lit(86_400_000_000)) / F.lit(1_000_000)).cast("decimal(18,6)"))
    text = F.replace((F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + day).cast("string"), F.lit(" "), F.lit("T"))
    return F.concat(F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text), F.lit("+00:00"))


def query_times(start: Column, end: Column) -> list[Column]:
    """start_time, end_time and latency_seconds of a query, as a results file holds them; null where it did not end."""
    return [iso_utc(start).alias("start_time"), iso_utc(end).alias("end_time"), F.round(end - start, 6).alias("latency_seconds")]


def write_results(found: DataFrame, path: str, **configuration: str | int | float) -> None:
    """Write results as JSON lines, each with the run's configuration."""
    conf = F.struct(*[F.lit(v).alias(k) for k, v in configuration.items()]) if configuration else F.lit(None).cast("string")
    query_results(found).select(conf.alias("configuration"), "*").write.mode("overwrite").json(path)
