"""Sessions: events of one identity and address without a gap of more than 30 minutes.

A key may hold a third of all events, so the order within a key is found day by day; what a day passes on
(its last event and the last session start) is one row a key and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.functions.columns import UNKNOWN, identity
from auditweave.functions.staging import staged

GAP_MS, DAY_MS = 1_800_000, 86_400_000
KEY = ["identity", "ip"]
LAYOUT = [*KEY, "session_day"]


def keyed(events: DataFrame, bucket_ms: int = DAY_MS) -> DataFrame:
    """``events`` with identity, ip and session_day, by which sessions are found."""
    who = events.withColumn("identity", identity()).withColumn("ip", F.coalesce("source_ip", F.lit(UNKNOWN)))
    return who.withColumn("session_day", F.floor(F.col("ts_ms") / bucket_ms))


def marked(dealt: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """keyed() events with session_start, the ts_ms and record_id of the session's first event.

    Uses its input three times, each time by key and day: read from a table in buckets of these, it is not shuffled."""
    day = Window.partitionBy(*LAYOUT).orderBy("ts_ms", "record_id")
    days = Window.partitionBy(*KEY).orderBy("session_day")
    last = dealt.groupBy(*LAYOUT).agg(F.max("ts_ms").alias("__last"))
    prior = last.withColumn("__prior", F.lag("__last").over(days)).drop("__last")
    previous = F.coalesce(F.lag("ts_ms").over(day), F.col("__prior"))
    fresh = previous.isNull() | (F.col("ts_ms") - previous > gap_ms)
    started = dealt.join(prior, LAYOUT).withColumn("__start", F.when(fresh, F.struct("ts_ms", "record_id")))
    here = F.last("__start", ignorenulls=True).over(day.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carried = started.groupBy(*LAYOUT).agg(F.max("__start").alias("__s"))
    before = F.last("__s", ignorenulls=True).over(days.rowsBetween(Window.unboundedPreceding, -1))
    carry = carried.withColumn("__carry", before).drop("__s")
    found = started.withColumn("__here", here).join(carry, LAYOUT)
    return found.withColumn("session_start", F.coalesce("__here", "__carry")).drop("__prior", "__start", "__here", "__carry")


def session_events(events: DataFrame, gap_ms: int = GAP_MS, bucket_ms: int = DAY_MS) -> DataFrame:
    """``events`` with identity, ip and session_start (the ts_ms and record_id of the session's first event).
    A gap of exactly ``gap_ms`` stays in the session."""
    return marked(keyed(events, bucket_ms), gap_ms).drop("session_day")


def facts(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(
        F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("events"), F.count("error_code").alias("errors")
    )


def first_seen(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, what, x, at): where each name and region of a key comes first."""
    pairs = F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("x")) for c in ("event_name", "aws_region")])
    each = rows.select(*key, "ts_ms", "record_id", F.explode(pairs).alias("p"))
    return each.groupBy(*key, "p.what", "p.x").agg(F.min(F.struct("ts_ms", "record_id")).alias("at"))


def session_id() -> Column:
    return F.sha2(F.concat_ws("|", "identity", "ip", F.col("session_start.ts_ms").cast("string"), F.col("session_start.record_id").cast("string")), 256).alias("session_id")


def bounds(marked: DataFrame) -> DataFrame:
    """(session_id, identity, ip, session_start, first_ms, last_ms, events, errors): sessions() without what takes a second
    pass."""
    return facts(marked, [*KEY, "session_start"]).withColumn("session_id", session_id())


def shaped(facts: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows a session from its facts and first_seen()."""
    key = [*KEY, "session_start"]

    def listed(what: str):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct("at", "x")))), lambda p: p["x"])

    named = facts.join(seen.groupBy(*key).agg(listed("event_name").alias("names"), listed("aws_region").alias("regions")), key)
    return named.select(session_id(), *key, "first_ms", "last_ms", (F.col("last_ms") - F.col("first_ms")).alias("duration_ms"), "events", "errors", "names", "regions")


def sessions(marked: DataFrame) -> DataFrame:
    """One row a session of session_events(): id, first, last, duration, counts, names and regions as first seen.

    Names and regions come from their first occurrences, so no list grows with the events of a session."""
    key = [*KEY, "session_start"]
    return shaped(facts(marked, key), first_seen(marked, key))


def numbered(found: DataFrame) -> DataFrame:
    """Sessions numbered from 0 in order of their first event: ranges of that order are numbered apart, and the
    counts of the ranges before, a row a range, are added."""
    order = ["session_start.ts_ms", "session_start.record_id", *KEY]
    ranged = staged(found.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "session-ranges")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranged.join(F.broadcast(offsets), "__range").withColumn("number", nth + F.col("__before")).drop("__range", "__before")


ORDERS = {"first": "first_ms", "duration": "duration_ms", "events": "events", "errors": "errors"}


def list_sessions(found: DataFrame, who: str = "", ip: str = "", start: int | None = None, end: int | None = None, order: str = "first") -> DataFrame:
    """Sessions whose identity holds ``who`` in any case and whose ip holds ``ip``, that overlap [start, end],
    by first, duration, events or errors, largest first; unknown orders count as first."""
    held = F.lit(True)
    if who:
        held = held & F.lower("identity").contains(who.lower())
    if ip:
        held = held & F.col("ip").contains(ip)
    if start is not None:
        held = held & (F.col("last_ms") >= start)
    if end is not None:
        held = held & (F.col("first_ms") <= end)
    return found.where(held).orderBy(F.desc(ORDERS.get(order, "first_ms")), "session_id")


def detail(found: DataFrame, marked: DataFrame, session_id: str) -> DataFrame:
    """The events of one session in time order, nine fields each. The session is looked up first, so that only events of its
    identity and address are sorted and marked; the last event of each key's day is found for all."""
    one = found.where(F.col("session_id") == session_id).select(*KEY, "session_start").first()  # one row
    rows = marked.where(F.lit(False))
    if one:
        rows = marked.where((F.col("identity") == one.identity) & (F.col("ip") == one.ip) & (F.col("session_start.record_id") == one.session_start.record_id) & (F.col("session_start.ts_ms") == one.session_start.ts_ms))
    return rows.select("record_id", "ts_ms", "event_time", "event_name", "event_source", "aws_region", "source_ip", "error_code", "read_only").orderBy("ts_ms", "record_id")


def index_by(found: DataFrame, column: str) -> DataFrame:
    """(value, session_id), a row a session, by ``identity`` or ``ip``: one value may hold a third of them."""
    return found.select(F.col(column).alias("value"), "session_id")


def index_counts(found: DataFrame, column: str) -> DataFrame:
    """(value, sessions) by ``identity`` or ``ip``."""
    return found.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("sessions"))
