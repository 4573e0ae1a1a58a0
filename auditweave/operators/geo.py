"""Addresses: places and networks by range join, gap filling, reputation, and the two rules on countries.

Networks come as tables of disjoint ranges (start_key, end_key, ...) with keys of functions.ip.ip_key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditweave.functions.columns import actor
from auditweave.functions.ip import ip_key, is_public
from auditweave.functions.staging import staged


def public_ips(events: DataFrame) -> DataFrame:
    """(source_ip, ip_key): the distinct public addresses. Parsing runs on distinct texts only."""
    distinct = events.where("source_ip IS NOT NULL").select("source_ip").distinct()
    return distinct.withColumn("ip_key", ip_key("source_ip")).where(is_public(F.col("source_ip"), F.col("ip_key")))


def in_order(ips: DataFrame, ranges: DataFrame, fields: list[str]) -> DataFrame:
    """(part, at, kind, range, source_ip): range starts (kind 0) and addresses (kind 1) together in address order, cut
    into parts at bounds that Spark samples from them, so that parts are even however addresses crowd."""
    held = F.struct("end_key", *fields)
    marks = ranges.select(F.col("start_key").alias("at"), F.lit(0).alias("kind"), held.alias("range"), F.lit(None).cast("string").alias("source_ip"))
    points = ips.select(F.col("ip_key").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["range"].dataType).alias("range"), "source_ip")
    parts = int(ips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return marks.unionByName(points).repartitionByRange(parts, "at", "kind", "source_ip").withColumn("part", F.spark_partition_id())


def in_ranges(ips: DataFrame, ranges: DataFrame, fields: list[str]) -> DataFrame:
    """(source_ip, fields) of each address inside a range: the last range that starts at or before it, if it
    has not ended. Ranges are disjoint, so one pass in address order finds it; what is open at the end of a part is
    carried over to the next ones by a row a part."""
    dealt = staged(in_order(ips, ranges, fields), "ip-ranges")
    ends = dealt.where("kind = 0").groupBy("part").agg(F.max_by("range", "at").alias("range")).select((F.col("part") + 1).alias("part"), "range")
    starts = dealt.select("part").distinct().join(ends, "part", "full")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a part
    carried = starts.select("part", F.last("range", ignorenulls=True).over(before).alias("carried"))
    order = Window.partitionBy("part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = F.coalesce(F.last("range", ignorenulls=True).over(order), F.col("carried"))
    found = dealt.join(F.broadcast(carried), "part").withColumn("hit", open_).where("kind = 1 AND at <= hit.end_key")
    return found.select("source_ip", *[F.col(f"hit.{name}").alias(name) for name in fields])


PLACE = ["country_code", "country_name", "city", "lat", "lon"]
NETWORK = ["asn", "asn_org"]


def enrich(events: DataFrame, places: DataFrame, networks: DataFrame | None = None) -> DataFrame:
    """(source_ip, place and network columns) of the public addresses; unknown ones have nulls."""
    ips = public_ips(events)
    out = ips.select("source_ip").join(in_ranges(ips, places, PLACE), "source_ip", "left")
    if networks is None:
        return out.withColumns({"asn": F.lit(None).cast("int"), "asn_org": F.lit(None).cast("string")})
    return out.join(in_ranges(ips, networks, NETWORK), "source_ip", "left")


def list_ips(counts: DataFrame, info: DataFrame | None, country: str | None = None, order: str = "events") -> DataFrame:
    """(source_ip, events, place, network) by events (most first), country (unknown last) or asn (unknown
    first), of one country if given. Without place data: the counts by events."""
    if info is None:
        return counts.orderBy(F.desc("events"), "source_ip")
    rows = counts.join(info, "source_ip", "left")
    if country:
        rows = rows.where(F.upper("country_code") == country.upper())
    first = {"country": F.coalesce("country_code", F.lit("ZZZ")).asc(), "asn": F.col("asn").asc_nulls_first()}.get(order, F.desc("events"))
    return rows.orderBy(first, "source_ip")


def fill_gaps(info: DataFrame, online: DataFrame) -> DataFrame:
    """Gaps of ``info`` filled from ``online`` (source_ip, status, country_code, country, city, as_text, org,
    isp) where its status is success; empty texts and AS 0 count as gaps."""
    rows = info.join(online.where("status = 'success'").select("source_ip", *[F.col(c).alias(f"__{c}") for c in ("country_code", "country", "city", "as_text", "org", "isp")]), "source_ip", "left")

    def first(*names: str):
        return F.coalesce(*[F.nullif(F.col(name), F.lit("")) for name in names])

    asn = F.nullif(F.regexp_extract("__as_text", r"^AS(\d+)", 1), F.lit("")).cast("int")
    return rows.select(
        "source_ip", first("country_code", "__country_code").alias("country_code"), first("country_name", "__country").alias("country_name"), first("city", "__city").alias("city"),
        F.coalesce(F.nullif("asn", F.lit(0)), asn).alias("asn"), first("asn_org", "__org", "__isp").alias("asn_org"), first("__isp").alias("isp"),
    )


def with_reputation(rows: DataFrame, reputation: DataFrame) -> DataFrame:
    """``rows`` with score, reports, usage, isp and domain of a reputation table keyed by source_ip."""
    wanted = ["abuse_score", "total_reports", "usage_type", "isp", "domain"]
    return rows.drop("isp").join(reputation.select("source_ip", *wanted), "source_ip", "left")


def countries(events: DataFrame, info: DataFrame) -> DataFrame:
    """(record_id, ts_ms, event_name, actor, country_code) of the events whose address has a country."""
    known = info.where("country_code IS NOT NULL").select("source_ip", "country_code")
    return events.select("record_id", "ts_ms", "event_name", "source_ip", actor().alias("actor")).join(known, "source_ip").drop("source_ip")


def in_many_countries(located: DataFrame) -> DataFrame:
    """Events of the actors seen in two countries or more."""
    many = located.groupBy("actor").agg(F.count_distinct("country_code").alias("n")).where("n >= 2")
    return located.join(many, "actor", "left_semi")


def away_from_baseline(located: DataFrame) -> DataFrame:
    """Console logins from a country in which the actor has no other event, of actors with other events."""
    base = located.where("event_name <> 'ConsoleLogin'").select("actor", "country_code").distinct()
    logins = located.where("event_name = 'ConsoleLogin'")
    return logins.join(base.select("actor").distinct(), "actor", "left_semi").join(base, ["actor", "country_code"], "left_anti")
