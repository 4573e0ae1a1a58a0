"""Object downloads: who read which objects of which buckets, and how many bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.functions.columns import actor, text_member, whole_bytes


def object_reads(events: DataFrame) -> DataFrame:
    """(record_id, ts_ms, bucket, key, bytes_out, identity, ip) of the GetObject events; bucket is null where
    the request names none."""
    return events.where("event_name = 'GetObject'").select(
        "record_id", "ts_ms", F.col("bucket_name").alias("bucket"), F.coalesce(text_member("request_parameters", "key"), F.lit("")).alias("key"),
        F.when(F.col("bucket_name").isNotNull(), whole_bytes("additional_event_data", "bytesTransferredOut")).otherwise(0).alias("bytes_out"),
        actor().alias("identity"), F.coalesce("source_ip", F.lit("")).alias("ip"),
    )


def select_reads(reads: DataFrame, start: int | None = None, end: int | None = None, bucket: str | None = None, ip: str | None = None, identity: str | None = None) -> DataFrame:
    """Reads in the inclusive range, of one bucket, ip or identity; the last three ask for a bucket."""
    held = F.lit(True)
    for name, value in (("bucket", bucket), ("ip", ip), ("identity", identity)):
        if value is not None:
            held = held & (F.col(name) == value) & F.col("bucket").isNotNull()
    if start is not None:
        held = held & (F.col("ts_ms") >= start)
    if end is not None:
        held = held & (F.col("ts_ms") <= end)
    return reads.where(held)


def totals(reads: DataFrame) -> DataFrame:
    """(bytes_out, reads, objects): reads count those without a bucket too."""
    one = F.when(F.col("bucket").isNotNull(), F.struct("bucket", "key"))
    return reads.agg(F.coalesce(F.sum("bytes_out"), F.lit(0)).alias("bytes_out"), F.count("*").alias("reads"), F.count_distinct(one).alias("objects"))


def by_bucket(reads: DataFrame) -> DataFrame:
    """(bucket, bytes_out, reads, top_identity): the identity of most bytes, ties to the first by name."""
    each = reads.where("bucket IS NOT NULL").groupBy("bucket", "identity").agg(F.sum("bytes_out").alias("b"), F.count("*").alias("n"))
    top = F.min(F.struct((-F.col("b")).alias("b"), "identity"))["identity"]
    return each.groupBy("bucket").agg(F.sum("b").alias("bytes_out"), F.sum("n").alias("reads"), top.alias("top_identity"))


def by_object(reads: DataFrame) -> DataFrame:
    return reads.where("bucket IS NOT NULL").groupBy("bucket", "key").agg(F.sum("bytes_out").alias("bytes_out"), F.count("*").alias("accesses"))


def top_objects(reads: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` objects of most bytes."""
    return by_object(reads).orderBy(F.desc("bytes_out"), "bucket", "key").limit(n)


def by_identity(reads: DataFrame) -> DataFrame:
    return reads.where("bucket IS NOT NULL").groupBy("identity").agg(F.sum("bytes_out").alias("bytes_out"), F.count("*").alias("reads"), F.count_distinct("bucket").alias("buckets"))


def choices(reads: DataFrame) -> DataFrame:
    """(what, value): the buckets, addresses and identities to choose from, in order."""
    named = reads.where("bucket IS NOT NULL")
    pairs = F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in ("bucket", "ip", "identity")])
    return named.select(F.explode(pairs).alias("p")).select("p.*").where("value <> ''").distinct().orderBy("what", "value")
