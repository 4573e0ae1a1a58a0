"""Detection: the catalogue of rules over an events table.

All rules take their candidates from one scan behind a test of the event name; bursts share one window. The fact table is alert_events(rule_id,
record_id, ts_ms, actor); alerts are its aggregate."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.functions.columns import actor, actor_or_ip
from auditweave.functions.staging import staged
from auditweave.operators import bursts, geo
from auditweave.operators.objects import object_reads
from auditweave.plans.catalogue import GEO_RULES, RULE_COLUMNS, RULES, SEVERITIES, SPARK, Rule, predicate, sql

SAMPLE = 100


def quoted(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def candidates(events: DataFrame, rules: list[Rule], *keep: str | Column) -> DataFrame:
    """(rule_id, keep...) of the events that satisfy each rule's predicate, from one scan.

    A map from event name to rules picks the few rules that an event can concern; only theirs of the payload
    tests are evaluated. Rules without names are tested on every event."""
    by_name: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        for name in rule.names:
            by_name.setdefault(name, []).append(k)
    # Texts of SQL rather than columns, for the map and the tests have hundreds of parts; and no lambda, which
    # would take the scan and the explode out of generated code.
    parts = ["CAST(array() AS array<int>)"]
    if by_name:
        table = ", ".join(f"{quoted(name)}, array({', '.join(map(str, ks))})" for name, ks in sorted(by_name.items()))
        names = ", ".join(map(quoted, sorted(by_name)))
        parts.append(f"CASE WHEN event_name IN ({names}) THEN coalesce(try_element_at(map({table}), event_name), {parts[0]}) ELSE {parts[0]} END")
    parts += [f"CASE WHEN {predicate(rule)} THEN array({k}) ELSE {parts[0]} END" for k, rule in enumerate(rules) if not rule.names]
    picked = F.expr(f"concat({', '.join(parts)})")
    rows = events.select("*", F.explode(picked).alias("__rule"))
    tests = [f"WHEN {k} THEN coalesce({sql(rule.where, SPARK)}, false)" for k, rule in enumerate(rules) if rule.names and rule.where]
    held = F.expr(f"CASE __rule {' '.join(tests)} ELSE true END") if tests else F.lit(True)
    ids = F.expr(f"element_at(array({', '.join(quoted(rule.rule_id) for rule in rules)}), __rule + 1)")
    return rows.where(held).select(ids.alias("rule_id"), *keep)


def key_of(rules: list[Rule]) -> Column:
    """The burst key of each rule: actor, actor or ip, ip, nothing; null for rules without a burst."""
    by = {"actor": actor(), "actor_or_ip": actor_or_ip(), "ip": F.col("source_ip"), "": F.lit("")}
    out = F.lit(None).cast("string")
    for key, column in by.items():
        ids = [rule.rule_id for rule in rules if rule.burst and rule.burst.key == key]
        if ids:
            out = F.when(F.col("rule_id").isin(ids), column).otherwise(out)
    return out


def keyed_candidates(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, record_id, ts_ms, actor, key) of the candidates of all ``rules``."""
    found = candidates(events, rules, "record_id", "ts_ms", "source_ip", "user_arn", "user_name", actor().alias("actor"))
    return found.withColumn("key", key_of(rules)).drop("source_ip", "user_arn", "user_name")


def in_bursts(found: DataFrame, rules: list[Rule], stretch: int = 1) -> DataFrame:
    """Of keyed_candidates(), those in the bursts of the burst rules."""
    keyed = [rule for rule in rules if rule.burst and rule.burst.key]
    free = [rule for rule in rules if rule.burst and not rule.burst.key]
    columns = ["rule_id", "record_id", "ts_ms", "actor", "key"]
    out = found.where(F.lit(False)).select(*columns)
    if keyed:

        def per_rule(value) -> Column:
            # A text: hundreds of columns take the driver a second.
            return F.expr(f"CASE rule_id {' '.join(f'WHEN {quoted(rule.rule_id)} THEN {value(rule.burst)}' for rule in keyed)} END")

        rows = found.where(F.col("rule_id").isin([rule.rule_id for rule in keyed]))
        counts = sorted({rule.burst.n for rule in keyed})
        out = bursts.first_bursts(rows, per_rule(lambda b: b.n), per_rule(lambda b: b.minutes * 60_000 * stretch), ["rule_id", "key"], counts).select(*columns)
    for rule in free:
        rows = found.where(F.col("rule_id") == rule.rule_id)
        out = out.unionByName(bursts.all_bursts(rows, rule.burst.n, rule.burst.minutes * 60_000 * stretch).select(*columns))
    return out


def burst_events(events: DataFrame, rules: list[Rule], stretch: int = 1) -> DataFrame:
    """alert_events of the burst rules. ``stretch`` multiplies every window, for sparse data."""
    rules = [rule for rule in rules if rule.burst]
    return in_bursts(staged(keyed_candidates(events, rules), "burst-candidates"), rules, stretch)


def alert_events(events: DataFrame, rules: list[Rule] | None = None, stretch: int = 1) -> DataFrame:
    """(rule_id, record_id, ts_ms, actor, key): every event that every built-in rule flags. key is the burst
    key, null for rules without a burst. With burst rules, the candidates of all rules are staged, so that
    the events are scanned once."""
    rules = RULES if rules is None else rules
    found = keyed_candidates(events, rules)
    if not any(rule.burst for rule in rules):
        return found
    found = staged(found, "rule-candidates")
    plain = found.where(F.col("rule_id").isin([rule.rule_id for rule in rules if not rule.burst]))
    return plain.unionByName(in_bursts(found, rules, stretch))


def geo_alert_events(events: DataFrame, places: DataFrame) -> DataFrame:
    """alert_events of the two rules on countries."""
    located = geo.countries(events, geo.enrich(events, places))
    both = [(GEO_RULES[0], geo.in_many_countries(located)), (GEO_RULES[1], geo.away_from_baseline(located))]
    parts = [rows.select(F.lit(rule.rule_id).alias("rule_id"), "record_id", "ts_ms", "actor", F.lit(None).cast("string").alias("key")) for rule, rows in both]
    return parts[0].unionByName(parts[1])


def rule_table(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rules as a small table, in catalogue order."""
    rows = [(k, r.rule_id, r.severity, SEVERITIES[r.severity], r.tactic, r.technique, r.service, r.title, r.evidence_query(), None) for k, r in enumerate(rules)]
    return events.sparkSession.createDataFrame(rows, RULE_COLUMNS)


def in_range(found: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """alert_events of a time range (both bounds needed); rules without events drop out with their rows."""
    return found if start is None or end is None else found.where(F.col("ts_ms").between(start, end))


def summaries(found: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(rule_id, matching_count, first_ms, last_ms, matching_record_ids, offenders) from one pass over alert_events.

    A task passes on a row a rule, with the ``sample`` smallest ids and burst keys that it met; these rows are merged
    in two steps, so that no value holds more than ``sample`` entries of each of some tasks."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by([("rule_id", "ascending"), ("record_id", "ascending")])
            rules, starts = np.unique(np.asarray(table["rule_id"]), return_index=True)
            for rule, part in zip(rules, (table.slice(i, j - i) for i, j in pairwise([*starts.tolist(), len(table)])), strict=True):
                n, first, last, ids, keys = held.get(rule, [0, 1 << 62, -(1 << 62), [], []])
                span = pc.min_max(part["ts_ms"]).as_py()
                named = {k for k in pc.unique(part["key"]).to_pylist() if k}
                ids = sorted(ids + part["record_id"].slice(0, sample).to_pylist())[:sample]
                held[rule] = [n + len(part), min(first, span["min"]), max(last, span["max"]), ids, sorted(named.union(keys))[:sample]]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
        rows = [[rule, *values] for rule, values in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)], names=["rule_id", "n", "first_ms", "last_ms", "ids", "keys"])

    def merged(rows: DataFrame, *by: str) -> DataFrame:
        def least(name: str) -> Column:
            return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(name))) if name == "keys" else F.array_sort(F.flatten(F.collect_list(name)))), 1, sample).alias(name)

        return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), least("ids"), least("keys"))

    parts = found.select("rule_id", "record_id", "ts_ms", "key").mapInArrow(meet, "rule_id string, n long, first_ms long, last_ms long, ids array<long>, keys array<string>")
    some = merged(parts.withColumn("team", F.spark_partition_id() % 64), "rule_id", "team")
    names = {"n": "matching_count", "ids": "matching_record_ids", "keys": "offenders"}
    return merged(some, "rule_id").withColumnsRenamed(names)


def assemble(found: DataFrame, rules: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """alerts: one row a rule with events - full count, the ``sample`` smallest ids and the ``sample`` first
    of those who offended (alert_events has all) - gravest first, then in catalogue order. The evidence query of a rule
    with a single offender is narrowed to them in each of its alternatives."""
    rows = summaries(found, sample).join(F.broadcast(rules), "rule_id")  # a row a rule
    one = F.when(F.size("offenders") == 1, F.col("offenders")[0])
    field = F.when(F.col("rule_id") == "IA-04", "sourceIPAddress").when(one.startswith("arn:"), "arn").otherwise("userName")
    scope = F.concat(F.lit(" "), field, F.lit('="'), one, F.lit('"'))
    scoped = F.concat(F.replace("query", F.lit(" OR "), F.concat(scope, F.lit(" OR "))), scope)
    narrowed = F.when(one.isNotNull() & (one != "unknown"), scoped).otherwise(F.col("query"))
    described = F.format_string("%s: %d event(s)", F.coalesce("about", "title"), F.col("matching_count"))
    out = rows.withColumn("query", narrowed).withColumn("description", described).drop("about")
    return out.orderBy(F.desc("severity_rank"), "ordinal")


def metadata(found: DataFrame, events: DataFrame, rules: list[Rule], custom: list[dict] | None = None) -> DataFrame:
    """(rule_id, metadata): the further facts of each alert as a map of texts; alerts of the user rules
    ``custom`` say that they are custom. Offenders are named up to SAMPLE; where
    there are more, ``offenders`` counts them."""
    facts = {name: [r.rule_id for r in rules if name in r.facts] for name in ("count", "offending_ips", "threshold", "identities", "total_bytes_out", "object_count", "total_run_instances")}
    keys = summaries(found.where("key <> ''")).select("rule_id", F.array_join("offenders", ", ").alias("keys"))
    often = found.where("key <> ''").select("rule_id", "key").distinct().groupBy("rule_id").agg(F.count("*").alias("n_keys"))
    reads = object_reads(events).select("record_id", "bytes_out")
    read = found.where("rule_id = 'EX-03'").join(reads, "record_id").groupBy("rule_id").agg(F.sum("bytes_out").alias("bytes"))
    started = events.where("event_name = 'RunInstances'").agg(F.count("*").alias("started")).withColumn("rule_id", F.lit("IM-01"))
    rows = found.groupBy("rule_id").agg(F.count("*").alias("n")).join(keys, "rule_id", "left").join(often, "rule_id", "left").join(read, "rule_id", "left").join(started, "rule_id", "left")
    limits = {r.rule_id: r.burst.n for r in rules if r.burst}
    values = {
        "count": F.col("n"), "offending_ips": F.col("keys"), "identities": F.col("keys"), "total_bytes_out": F.col("bytes"),
        "object_count": F.col("n"), "total_run_instances": F.col("started"), "threshold": F.lit(limits.get("IA-04", 0)),
    }
    entries = [F.when(F.col("rule_id").isin(ids), F.struct(F.lit(name).alias("k"), values[name].cast("string").alias("v"))) for name, ids in facts.items()]
    naming = facts["offending_ips"] + facts["identities"]
    entries.append(F.when(F.col("rule_id").isin(naming) & (F.col("n_keys") > SAMPLE), F.struct(F.lit("offenders").alias("k"), F.col("n_keys").cast("string").alias("v"))))
    if custom:
        entries.append(F.when(F.col("rule_id").isin([rule["id"] for rule in custom]), F.struct(F.lit("source").alias("k"), F.lit("custom").alias("v"))))
    return rows.select("rule_id", F.map_from_entries(F.array_compact(F.array(*entries))).alias("metadata"))


def run(events: DataFrame, places: DataFrame | None = None, custom: list[dict] | None = None, start: int | None = None, end: int | None = None, rules: list[Rule] | None = None, stretch: int = 1, facts: bool = False) -> DataFrame:
    """Alerts of the built-in rules, of the rules on countries if place data is given, and of user rules,
    counted in full within the range; with ``facts``, each with its metadata."""
    from auditweave.operators import custom_rules

    rules = list(RULES if rules is None else rules)
    found = alert_events(events, rules, stretch)
    table = rule_table(events, rules + (GEO_RULES if places is not None else []))
    if places is not None:
        found = found.unionByName(geo_alert_events(events, places))
    good = custom_rules.validate(custom)[0] if custom else []
    if good:
        found = found.unionByName(custom_rules.alert_events(events, good))
        table = table.unionByName(custom_rules.rule_table(events, good, len(rules) + 2))
    found = in_range(found, start, end)
    if facts:  # these read the flagged events again
        found = staged(found, "alert-events")
    alerts = assemble(found, table)
    if facts:
        alerts = alerts.join(metadata(found, events, rules, good), "rule_id").orderBy(F.desc("severity_rank"), "ordinal")
    return alerts


def evidence(events: DataFrame, alert_query: str) -> DataFrame:
    """The events that an alert's evidence query shows, which hold all it flags and may hold more."""
    from auditweave.operators.search import search

    return search(events, alert_query)


def flagged(events: DataFrame, found: DataFrame, rule_id: str) -> DataFrame:
    """The events that a rule flags, exactly: those whose ids alert_events has for it."""
    return events.join(found.where(F.col("rule_id") == rule_id).select("record_id").distinct(), "record_id", "left_semi")
