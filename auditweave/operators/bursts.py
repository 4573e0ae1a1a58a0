"""Bursts: at least n events within a time window, for each key or over all events.

A busy key may hold a third of all events, and a busy window a tenth of those, so neither goes to one task. Time is cut into
buckets as long as the window. In a bucket, the n-th event and all later ones complete n events by themselves; whether
one of the first n does takes these and the last n - 1 of the bucket before. Each task passes on as many rows of a
bucket, so sorts and windows see 2n - 1 rows of a bucket, however many it holds. Hits then meet by aggregation and join.
Keys are not null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(events: DataFrame, n: Column | int, window_ms: Column | int, key: list[str], counts: list[int] | None = None) -> DataFrame:
    """The first n rows of each bucket (__first), and the last n - 1 once more, in the next bucket: with __n, __w and
    __bucket. In a bucket all that come from the one before are earlier.

    n may be a column over the numbers ``counts``, and window_ms a column, both fixed for a key."""
    counts = [n] if isinstance(n, int) else counts
    n, window_ms = (F.lit(x) if isinstance(x, int) else x for x in (n, window_ms))
    rows = events.select("*", n.alias("__n"), window_ms.cast("long").alias("__w"), F.floor(F.col("ts_ms") / window_ms).alias("__bucket"))
    at = Window.partitionBy(*key, "__bucket")

    def some(most: int, of_each: Column, *order: Column) -> DataFrame:
        # The bound that is a number lets tasks drop rows before the shuffle.
        return rows.withColumn("__nth", F.row_number().over(at.orderBy(*order))).where((F.col("__nth") <= most) & (F.col("__nth") <= of_each)).drop("__nth")

    heads = some(max(counts), F.col("__n"), F.asc("ts_ms"), F.asc("record_id")).withColumn("__first", F.lit(True))
    tails = some(max(counts) - 1, F.col("__n") - 1, F.desc("ts_ms"), F.desc("record_id")).withColumn("__first", F.lit(False))
    return heads.unionByName(tails.withColumn("__bucket", F.col("__bucket") + 1))


def with_hits(edges: DataFrame, key: list[str], counts: list[int]) -> DataFrame:
    """edges() with __hit: whether one of the first rows of its bucket is the n-th or a later one within the window up to and
    including itself, in order of (ts_ms, record_id)."""
    order = Window.partitionBy(*key, "__bucket").orderBy("ts_ms", "record_id")
    back = F.lit(None).cast("long")
    for count in sorted(set(counts)):
        back = F.when(F.col("__n") == count, F.lag("ts_ms", count - 1).over(order)).otherwise(back)
    rows = edges.withColumn("__back", back)
    return rows.withColumn("__hit", F.col("__first") & F.coalesce(F.col("ts_ms") - F.col("__back") <= F.col("__w"), F.lit(False))).drop("__back")


def hits(events: DataFrame, n: Column | int, window_ms: Column | int, key: list[str], counts: list[int] | None = None) -> DataFrame:
    """``events`` (key columns, ts_ms, record_id, ...) that are the n-th or a later one within ``window_ms`` up to and
    including themselves: of each bucket those among its first n, so the first hit of each bucket is there."""
    counts = [n] if isinstance(n, int) else counts
    return with_hits(edges(events, n, window_ms, key, counts), key, counts).where("__hit").drop("__hit", "__first", "__bucket")


def first_bursts(events: DataFrame, n: Column | int, window_ms: Column | int, key: list[str], counts: list[int] | None = None) -> DataFrame:
    """The events of each key's first burst: the first event that completes n within the window, and the
    n - 1 before it. One burst a key."""
    counts = [n] if isinstance(n, int) else counts
    rows = with_hits(edges(events, n, window_ms, key, counts), key, counts)
    others = [name for name in events.columns if name not in key]
    at = F.struct("ts_ms", "record_id")
    each = F.struct(at.alias("__at"), *others)
    held = rows.groupBy(*key, "__bucket").agg(F.min(F.when(F.col("__hit"), at)).alias("hit"), F.any_value("__n").alias("__n"), F.collect_list(each).alias("rows")).where("hit IS NOT NULL")
    first = held.groupBy(*key).agg(F.min_by(F.struct("hit", "__n", "rows"), "hit").alias("b"))
    near = F.array_sort(F.filter("b.rows", lambda row: row["__at"] <= F.col("b.hit")))
    burst = F.slice(near, F.greatest(F.size(near) - F.col("b.__n"), F.lit(0)) + 1, F.col("b.__n"))
    return first.select(*key, F.explode(burst).alias("row")).select(*[F.col(name) if name in key else F.col(f"row.{name}") for name in events.columns])


def all_bursts(events: DataFrame, n: int, window_ms: int, key: list[str] | None = None) -> DataFrame:
    """The events inside any burst: every event with a hit no later than ``window_ms`` after it such that it
    belongs to the window of that hit.

    A bucket with n events is a burst, so all of it belongs; the others have fewer than n rows to compare with hits."""
    key = key or []
    at = [*key, "__bucket"]
    rows = events.withColumn("__bucket", F.floor(F.col("ts_ms") / window_ms))
    full = rows.groupBy(*at).agg(F.count("*").alias("__held")).where(F.col("__held") >= n).select(*at)
    inside = rows.join(full, at, "left_semi").drop("__bucket")
    met = with_hits(edges(events, n, window_ms, key), key, [n])
    rare = met.where("__first").withColumn("__held", F.count("*").over(Window.partitionBy(*at))).where(F.col("__held") < n)
    # Of the hits that an event can belong to, the nearest decides: in the event's own bucket, or the first of the next.
    found = met.where("__hit").select(*key, "ts_ms", F.explode(F.array(F.col("__bucket"), F.col("__bucket") - 1)).alias("__bucket")).distinct()
    both = rare.withColumn("__mark", F.lit(False)).unionByName(found.withColumn("__mark", F.lit(True)), allowMissingColumns=True)
    # From the end on: Spark computes a frame that ends after all rows anew for each row.
    after = Window.partitionBy(*at).orderBy(F.desc("ts_ms"), F.desc("__mark")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.last(F.when(F.col("__mark"), F.col("ts_ms")), ignorenulls=True).over(after)
    near = both.withColumn("__reach", reach).where(~F.col("__mark") & (F.col("__reach") - F.col("ts_ms") <= window_ms))
    return inside.select(*events.columns).unionByName(near.select(*events.columns))


def if_any_burst(events: DataFrame, n: int, window_ms: int) -> DataFrame:
    """All events if any window holds n of them, none otherwise."""
    any_hit = hits(events, n, window_ms, []).select(F.lit(1).alias("__any")).limit(1)
    return events.crossJoin(F.broadcast(any_hit)).drop("__any")  # one row or none
