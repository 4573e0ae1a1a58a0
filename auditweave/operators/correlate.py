"""Sessions and alerts: which touch each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.operators.sessions import KEY


def alerts_of_session(marked: DataFrame, found: DataFrame) -> DataFrame:
    """(identity, ip, session_start, rule_id, events): the rules with events in each session, and how many."""
    return found.select("rule_id", "record_id").distinct().join(marked.select("record_id", *KEY, "session_start"), "record_id").groupBy(*KEY, "session_start", "rule_id").agg(F.count("*").alias("events"))


def sessions_of_alert(found_sessions: DataFrame, marked: DataFrame, found: DataFrame, rule_id: str) -> DataFrame:
    """The sessions that hold events of a rule."""
    rows = marked.join(found.where(F.col("rule_id") == rule_id).select("record_id"), "record_id", "left_semi")
    return found_sessions.join(rows.select(*KEY, "session_start").distinct(), [*KEY, "session_start"], "left_semi")
