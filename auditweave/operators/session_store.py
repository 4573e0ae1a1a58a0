"""Sessions as tables of one layout, in buckets of identity, address and day.

Events are dealt by identity, address and day once, when they are stored. All that follows finds its rows where they lie: marks,
the parts of sessions (a row a session and day), the rules with events in them, and joins among these shuffle
no event. What goes from day to day, and from parts to whole sessions, is a row a key or session and day.

A key's day is one task, as in session_events(); longer activity of a key is spread over its days. Tables go to the
shared folder, in the session's catalogue; drop() removes their names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.functions.staging import shared_folder
from auditweave.operators.detect import candidates
from auditweave.operators.sessions import GAP_MS, KEY, LAYOUT, facts, first_seen, keyed, marked, shaped
from auditweave.plans.catalogue import RULES, Rule

PART = [*LAYOUT, "session_start"]
SESSION = [*KEY, "session_start"]


def bucketed(rows: DataFrame, table: str, buckets: int, *order: str) -> DataFrame:
    """``rows``, which have the columns of LAYOUT, as a table of that layout. Rows that lie in these buckets already
    are written by the tasks that hold them. Joins among such tables are by LAYOUT alone, as Spark asks that the columns
    of the buckets be those of the join."""
    path = f"{shared_folder(rows.sparkSession)}/{table}-{uuid.uuid4().hex}"
    rows.write.option("path", path).bucketBy(buckets, *LAYOUT).sortBy(*LAYOUT, *order).saveAsTable(table)
    return rows.sparkSession.table(table)


class Store:
    """The tables ``name``_events, _marks, _parts and _seen.

    buckets: as many as let a bucket of events fit into a task; by default those of a shuffle."""

    def __init__(self, events: DataFrame, name: str, buckets: int | None = None, gap_ms: int = GAP_MS) -> None:
        self.spark, self.name = events.sparkSession, name
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = keyed(events).repartition(self.buckets, *LAYOUT)  # the one shuffle of the events
        self.dealt = bucketed(dealt, f"{name}_events", self.buckets, "ts_ms", "record_id")
        self.marks = bucketed(marked(self.dealt, gap_ms), f"{name}_marks", self.buckets, "ts_ms", "record_id")
        self.parts = bucketed(facts(self.marks, PART), f"{name}_parts", self.buckets)
        self.seen = bucketed(first_seen(self.marks, PART), f"{name}_seen", self.buckets)

    def sessions(self) -> DataFrame:
        """As sessions.sessions(), from the parts alone."""
        whole = self.parts.groupBy(*SESSION).agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.sum("events").alias("events"), F.sum("errors").alias("errors"))
        return shaped(whole, self.seen.groupBy(*SESSION, "what", "x").agg(F.min("at").alias("at")))

    def events(self) -> DataFrame:
        """The marked events with what their session does on their day: day_first_ms, day_last_ms, day_events, day_errors."""
        names = ("first_ms", "last_ms", "events", "errors")
        # The parts of a key's day are fewer than gaps fit into it, so they come as one row, by the columns of the layout alone.
        held = self.parts.groupBy(*LAYOUT).agg(F.collect_list(F.struct("session_start", *names)).alias("__parts"))
        mine = F.filter("__parts", lambda part: part["session_start"] == F.col("session_start"))[0]
        both = self.marks.join(held, LAYOUT).withColumn("__part", mine)
        return both.select(*self.marks.columns, *[F.col("__part")[name].alias(f"day_{name}") for name in names])

    def alert_parts(self, rules: list[Rule] | None = None) -> DataFrame:
        """(PART, rule_id, events): the rules without a burst that have events in each part, from the scan that tests them."""
        plain = [rule for rule in (RULES if rules is None else rules) if not rule.burst]
        return candidates(self.marks, plain, *PART).groupBy(*PART, "rule_id").agg(F.count("*").alias("events"))

    def alerts_of_sessions(self, rules: list[Rule] | None = None) -> DataFrame:
        """As correlate.alerts_of_session(), of the rules without a burst."""
        return self.alert_parts(rules).groupBy(*SESSION, "rule_id").agg(F.sum("events").alias("events"))

    def drop(self) -> None:
        for table in ("events", "marks", "parts", "seen"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")
