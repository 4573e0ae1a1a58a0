"""Histograms, facets and identity profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditweave.schema import FACETS, FIELDS


def histogram(events: DataFrame, buckets: int = 60) -> DataFrame:
    """(bucket, start_ms, end_ms, events): the time line in at most ``buckets`` (1 to 100) equal parts, empty
    ones included. No events: no rows. The bounds join as one row, so nothing runs on the driver."""
    n = max(1, min(buckets, 100))
    span = events.agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi")).where("lo IS NOT NULL")
    sized = span.select("lo", "hi", F.greatest(F.expr(f"(hi - lo + {n} - 1) div {n}"), F.lit(1)).alias("width"))
    sized = sized.withColumn("n", F.greatest(F.expr("(hi - lo + width - 1) div width"), F.lit(1)))
    line = sized.select("lo", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("bucket"))
    placed = events.select("ts_ms").crossJoin(F.broadcast(sized))  # one row
    counts = placed.groupBy(F.least(F.expr("(ts_ms - lo) div width"), F.col("n") - 1).alias("bucket")).agg(F.count("*").alias("events"))
    start = F.col("lo") + F.col("bucket") * F.col("width")
    return line.join(counts, "bucket", "left").select("bucket", start.alias("start_ms"), (start + F.col("width") - 1).alias("end_ms"), F.coalesce("events", F.lit(0)).alias("events"))


def value_counts(events: DataFrame, name: str) -> DataFrame:
    """(value, events) of a field, nulls left out. Unknown names are an error."""
    if name not in FIELDS:
        raise ValueError(f"unknown field {name}")
    column = F.col(FIELDS[name])
    return events.where(column.isNotNull()).groupBy(column.alias("value")).agg(F.count("*").alias("events"))


def top_values(events: DataFrame, name: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    return value_counts(events, name).orderBy(F.desc("events"), "value").limit(n)


def facets(events: DataFrame, names: list[str] | None = None, n: int = 20) -> DataFrame:
    """(field, value, events, nth): the top ``n`` of several fields in one pass."""
    names = FACETS if names is None else names
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), F.col(FIELDS[name]).alias("value")) for name in names])
    counts = events.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("events"))
    nth = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("events"), "value"))
    return counts.withColumn("nth", nth).where(F.col("nth") <= n)


def of_identity(events: DataFrame, who: str) -> DataFrame:
    """Events of an identity: those of that ARN if any event has it, else those of that user name."""
    by_arn = events.where(F.col("user_arn") == who).limit(1).select(F.lit(True).alias("is_arn"))
    known = events.sparkSession.range(1).join(by_arn, F.lit(True), "left").select(F.coalesce("is_arn", F.lit(False)).alias("is_arn"))
    rows = events.where((F.col("user_arn") == who) | (F.col("user_name") == who)).crossJoin(F.broadcast(known))  # one row
    return rows.where(F.when(F.col("is_arn"), F.col("user_arn") == who).otherwise(F.col("user_name") == who)).drop("is_arn")


def in_range(events: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Inclusive; holds only where both bounds are given."""
    return events if start is None or end is None else events.where(F.col("ts_ms").between(start, end))


def profile(events: DataFrame, who: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """(events, names, first_ms, last_ms) of an identity: no row if it is unknown, zeros if the range is empty."""
    mine = of_identity(events, who)
    inside = F.lit(True) if start is None or end is None else F.col("ts_ms").between(start, end)
    total = mine.agg(
        F.count("*").alias("known"), F.count_if(inside).alias("events"), F.count_distinct(F.when(inside, F.col("event_name"))).alias("names"),
        F.coalesce(F.min(F.when(inside, F.col("ts_ms"))), F.lit(0)).alias("first_ms"), F.coalesce(F.max(F.when(inside, F.col("ts_ms"))), F.lit(0)).alias("last_ms"),
    )
    return total.where("known > 0").drop("known")


def by_name(events: DataFrame) -> DataFrame:
    """(event_name, events, first_ms, last_ms, error_codes) with the distinct error codes sorted."""
    return events.groupBy("event_name").agg(
        F.count("*").alias("events"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.array_sort(F.collect_set("error_code")).alias("error_codes")
    )


def feed(events: DataFrame, who: str) -> DataFrame:
    """The rows of an identity's feed."""
    return of_identity(events, who).select("record_id", "ts_ms", "event_time", "event_name", "event_source", "aws_region", "source_ip", "error_code", "request_parameters")


def ip_counts(events: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """(source_ip, events), nulls left out."""
    return in_range(events, start, end).where("source_ip IS NOT NULL").groupBy("source_ip").agg(F.count("*").alias("events"))


def distinct_values(events: DataFrame, column: str) -> DataFrame:
    return events.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().orderBy("value")


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count("*").alias("alerts"))


def alert_groups(alerts: DataFrame, by: str) -> DataFrame:
    """Alerts by ``severity`` (gravest first), ``service`` or ``mitre_tactic`` (most first), with their rules."""
    grouped = alerts.groupBy(by).agg(F.count("*").alias("alerts"), F.max("severity_rank").alias("gravest"), F.array_sort(F.collect_list("rule_id")).alias("rules"))
    return grouped.orderBy(*([F.desc("gravest")] if by == "severity" else [F.desc("alerts"), by]))


def filter_alerts(alerts: DataFrame, text: str = "", severity: str | None = None) -> DataFrame:
    """Alerts whose title, rule or service holds ``text`` in any case, of one severity if given."""
    held = F.lit(True)
    if text:
        low = text.lower()
        held = F.lower("title").contains(low) | F.lower("rule_id").contains(low) | F.lower(F.coalesce("service", F.lit(""))).contains(low)
    return alerts.where(held & (F.col("severity") == severity) if severity else held)


def load_report(events: DataFrame) -> DataFrame:
    """(path, records) of each source file."""
    return events.groupBy("path").agg(F.count("*").alias("records"))


def source_summary(events: DataFrame) -> DataFrame:
    """(files, events, earliest_ms, latest_ms), unreadable times (0) left out of the bounds."""
    at = F.when(F.col("ts_ms") != 0, F.col("ts_ms"))
    return events.agg(F.count_distinct("path").alias("files"), F.count("*").alias("events"), F.min(at).alias("earliest_ms"), F.max(at).alias("latest_ms"))
