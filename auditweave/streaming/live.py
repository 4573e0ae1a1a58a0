"""Streams of delivered files: the same readers and rules, and sessions with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.functions.columns import UNKNOWN, actor, identity
from auditweave.operators.detect import candidates
from auditweave.plans.catalogue import RULES
from auditweave.sources.ingest import BINARY, NAMES, RECORD, decode, with_derived


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """Valid events of new files below ``root``. Rejecting a whole file for one record needs all its records
    at once, so a stream drops the bad records only."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).load(root).where(F.col("path").rlike(NAMES))
    return with_derived(decode(files, lenient=True).where(F.col("kind") == RECORD))


def stream_alert_events(events: DataFrame) -> DataFrame:
    """alert_events of the rules without a burst, as they arrive."""
    return candidates(events, [rule for rule in RULES if not rule.burst], "record_id", "ts_ms", actor().alias("actor"))


def stream_sessions(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(identity, ip, first_ms, last_ms, events, errors) once a session has closed. The window is half open,
    so its gap is a millisecond over 30 minutes: a gap of exactly 30 minutes stays in the session."""
    timed = events.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    key = [identity().alias("identity"), F.coalesce("source_ip", F.lit(UNKNOWN)).alias("ip")]
    grouped = timed.groupBy(F.session_window("at", "1800001 milliseconds"), *key)
    return grouped.agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("events"), F.count("error_code").alias("errors")).drop("session_window")
