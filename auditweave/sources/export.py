"""Writing events: CSV, JSON lines, and the partitioned events table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from auditweave.operators.search import in_time_order
from auditweave.schema import PATHS

#: The CSV header and its columns.
CSV_COLUMNS = {
    "eventTime": "event_time", "eventName": "event_name", "eventSource": "event_source", "awsRegion": "aws_region",
    "sourceIPAddress": "source_ip", "userName": "user_name", "userArn": "user_arn", "errorCode": "error_code",
}
PAYLOADS = ["request_parameters", "response_elements", "additional_event_data"]


def csv_rows(events: DataFrame) -> DataFrame:
    """The eight columns in time order, under their delivered names."""
    return in_time_order(events).select(*[F.col(c).alias(name) for name, c in CSV_COLUMNS.items()])


def csv_lines(events: DataFrame) -> DataFrame:
    """(ts_ms, record_id, line): each event as a CSV line; nulls are empty, quotes only where needed."""

    def cell(name: str):
        text = F.coalesce(F.col(name), F.lit(""))
        return F.when(text.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return events.select("ts_ms", "record_id", F.concat_ws(",", *[cell(c) for c in CSV_COLUMNS.values()]).alias("line"))


def counted(rows: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Writes ``rows`` and says how many they were, from a metric on the way: no second pass."""
    seen = Observation()
    write(rows.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]


def write_csv(events: DataFrame, path: str) -> int:
    """Gives the number of rows."""
    options = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""}
    return counted(csv_rows(events), lambda rows: rows.write.options(**options).csv(path))


def full_json(events: DataFrame, *keep: str) -> DataFrame:
    """(ts_ms, record_id, keep..., line): each event as one JSON object under delivered names; payloads come last, with the
    text that they were delivered with (line breaks between their members as spaces). Nulls are left out, as are
    payloads that are not JSON."""
    identity = {name: path.split(".")[1] for name, path in PATHS.items() if path.startswith("userIdentity.") and name != "session_context"}
    resources = F.transform("resources", lambda r: F.struct(r["account_id"].alias("accountId"), r["type"].alias("type"), r["arn"].alias("ARN")))
    plain = [F.col(name).alias(path) for name, path in PATHS.items() if "." not in path and name not in PAYLOADS]
    plain += [F.col(name).alias(path) for name, path in (("request_id", "requestID"), ("read_only", "readOnly"), ("management_event", "managementEvent"), ("shared_event_id", "sharedEventID"))]

    def inside(*parts: Column) -> Column:
        """The members of an object, without its braces; null if it has none."""
        text = F.to_json(F.struct(*parts))
        return F.nullif(F.substring(text, F.lit(2), F.length(text) - 2), F.lit(""))

    def verbatim(name: str, path: str) -> Column:
        sound = F.get_json_object(name, "$").isNotNull()
        return F.when(sound, F.concat(F.lit(f'"{path}":'), F.regexp_replace(name, r"[\r\n]", " ")))

    who = F.concat(F.lit('"userIdentity":{'), F.concat_ws(",", inside(*[F.col(name).alias(short) for name, short in identity.items()]), verbatim("session_context", "sessionContext")), F.lit("}"))
    line = F.concat(F.lit("{"), F.concat_ws(",", inside(*plain, resources.alias("resources")), who, *[verbatim(name, PATHS[name]) for name in PAYLOADS]), F.lit("}"))
    return events.select("ts_ms", "record_id", *keep, line.alias("line"))


def write_json(events: DataFrame, path: str) -> int:
    """One JSON object a line, in time order; a single array would need a single writer. Gives the number of rows."""
    return counted(in_time_order(full_json(events)).select("line"), lambda rows: rows.write.text(path))


def export_counts(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("rows"))


def write_table(events: DataFrame, path: str) -> int:
    """The events table, partitioned by event date and dealt by it, so that a day is few files. Gives the number of rows."""
    dated = events.withColumn("event_date", F.to_date(F.timestamp_millis("ts_ms")))
    dealt = dated.hint("rebalance", "event_date").sortWithinPartitions("ts_ms")
    return counted(dealt, lambda rows: rows.write.partitionBy("event_date").parquet(path))
