"""User rules: event names, a filter tree and a threshold, given as dictionaries (for instance from YAML).

{id, name, severity, enabled?, mitre_tactic?, mitre_technique?, service?, description?,
 match: {event_name: text or list}, filters?: tree, threshold?: {min_count, window_minutes?}}"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.functions.columns import actor
from auditweave.functions.staging import staged
from auditweave.operators import bursts
from auditweave.operators.search import tree_column
from auditweave.plans.catalogue import RULE_COLUMNS, SEVERITIES

#: The fields that filters may name, and their columns.
FILTER_FIELDS = {
    "identity_type": "identity_type", "error_code": "error_code", "source_ip": "source_ip", "user_name": "user_name",
    "user_arn": "user_arn", "event_source": "event_source", "region": "aws_region", "account_id": "account_id",
    "user_agent": "user_agent", "bucket_name": "bucket_name",
}

#: Rules to start from.
STARTERS = [
    {"id": "CR-01", "name": "Secret read from an unknown region", "severity": "high", "service": "SecretsManager", "match": {"event_name": "GetSecretValue"}, "filters": {"not": {"or": [{"field": "region", "value": "us-east-1"}, {"field": "region", "value": "eu-west-1"}]}}},
    {"id": "CR-02", "name": "Root changes identities", "severity": "critical", "service": "IAM", "match": {"event_name": ["CreateUser", "CreateAccessKey", "AttachUserPolicy"]}, "filters": {"field": "identity_type", "value": "Root"}},
    {"id": "CR-03", "name": "Many refused role changes", "severity": "medium", "service": "STS", "match": {"event_name": "AssumeRole"}, "filters": {"field": "error_code", "value": "AccessDenied"}, "threshold": {"min_count": 5, "window_minutes": 10}},
    {"id": "CR-04", "name": "Buckets deleted", "severity": "high", "service": "S3", "description": "A bucket or its encryption was deleted", "match": {"event_name": ["DeleteBucket", "DeleteBucketEncryption"]}},
    {"id": "CR-05", "name": "Command sent by a user", "severity": "low", "service": "SSM", "match": {"event_name": "SendCommand"}, "filters": {"and": [{"field": "identity_type", "value": "IAMUser"}, {"not": {"field": "error_code", "value": "AccessDenied"}}]}},
]


def names_of(rule: dict) -> list[str]:
    names = rule["match"]["event_name"]
    return sorted({names} if isinstance(names, str) else set(names))


def check_tree(tree: dict) -> None:
    if "field" in tree:
        if tree["field"] not in FILTER_FIELDS or not isinstance(tree["value"], str):
            raise ValueError(f"not a filter: {tree}")
    elif "not" in tree:
        check_tree(tree["not"])
    else:
        for part in tree["and"] if "and" in tree else tree["or"]:
            check_tree(part)


def validate(rules: list[dict]) -> tuple[list[dict], list[str]]:
    """The rules that can run, and what is wrong with the others. A rule of the wrong shape fails the whole
    list; an empty id, no names, a count of zero drop that rule, and an id given twice drops all of that id."""
    try:
        for rule in rules:
            names, severity = rule["match"]["event_name"], rule["severity"]
            if not isinstance(rule["id"], str) or not isinstance(rule["name"], str) or severity not in SEVERITIES or not isinstance(names, (str, list)):
                raise ValueError(f"not a rule: {rule}")
            if rule.get("filters"):
                check_tree(rule["filters"])
            if rule.get("threshold") and not isinstance(rule["threshold"]["min_count"], int):
                raise ValueError(f"not a threshold: {rule['threshold']}")
    except (KeyError, TypeError, ValueError) as error:
        return [], [f"malformed rules: {error}"]
    often = Counter(rule["id"] for rule in rules)
    good, errors = [], [f"{rule_id}: given {n} times" for rule_id, n in often.items() if n > 1 and rule_id]
    for rule in rules:
        wrong = "empty id" if not rule["id"].strip() else "no event names" if not [n for n in names_of(rule) if n] else "min_count is 0" if (rule.get("threshold") or {}).get("min_count", 1) < 1 else ""
        if wrong:
            errors.append(f"{rule['id']}: {wrong}")
        elif often[rule["id"]] == 1:
            good.append(rule)
    return good, errors


def matches(events: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule_id, record_id, ts_ms, actor) of the events of each rule's names that pass its filters, thresholds
    aside, from one scan."""
    none = F.array().cast("array<string>")
    held = []
    for rule in rules:
        found = F.col("event_name").isin(names_of(rule))
        if rule.get("filters"):
            found = found & F.coalesce(tree_column(rule["filters"], FILTER_FIELDS), F.lit(False))
        held.append(F.when(found, F.array(F.lit(rule["id"]))).otherwise(none))
    named = sorted({name for rule in rules for name in names_of(rule)})
    rows = events.where(F.col("event_name").isin(named)) if named else events.where(F.lit(False))
    return rows.select(F.explode(F.concat(none, *held)).alias("rule_id"), "record_id", "ts_ms", actor().alias("actor"))


def reached(found: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule_id) of the rules whose threshold matches() reaches: any window holds min_count events, or without
    window_minutes, there are so many at all. A row a rule at most."""
    counted = [rule for rule in rules if rule["threshold"].get("window_minutes") is None]
    timed = [rule for rule in rules if rule["threshold"].get("window_minutes") is not None]
    out = found.where(F.lit(False)).select("rule_id")
    if counted:
        least = F.create_map(*[F.lit(x) for rule in counted for x in (rule["id"], rule["threshold"]["min_count"])])
        often = found.where(F.col("rule_id").isin([rule["id"] for rule in counted])).groupBy("rule_id").agg(F.count("*").alias("n"))
        out = out.unionByName(often.where(F.col("n") >= least[F.col("rule_id")]).select("rule_id"))
    if timed:
        least = F.create_map(*[F.lit(x) for rule in timed for x in (rule["id"], rule["threshold"]["min_count"])])
        span = F.create_map(*[F.lit(x) for rule in timed for x in (rule["id"], rule["threshold"]["window_minutes"] * 60_000)])
        rows = found.where(F.col("rule_id").isin([rule["id"] for rule in timed]))
        hit = bursts.hits(rows, least[F.col("rule_id")], span[F.col("rule_id")], ["rule_id"], [rule["threshold"]["min_count"] for rule in timed])
        out = out.unionByName(hit.select("rule_id").distinct())
    return out


def alert_events(events: DataFrame, rules: list[dict]) -> DataFrame:
    """alert_events of the enabled rules, not capped: all matches, and with a threshold all if it is reached
    and none otherwise. One scan of the events for all rules; with thresholds their matches are staged."""
    rules = [rule for rule in rules if rule.get("enabled", True)]
    found = matches(events, rules)
    limited = [rule for rule in rules if rule.get("threshold")]
    if limited:
        found = staged(found, "user-rule-matches")
        free = found.where(~F.col("rule_id").isin([rule["id"] for rule in limited]))
        found = free.unionByName(found.join(F.broadcast(reached(found, limited)), "rule_id", "left_semi"))  # a row a rule
    return found.withColumn("key", F.lit(None).cast("string"))


def rule_table(events: DataFrame, rules: list[dict], first: int = 0) -> DataFrame:
    rows = [
        (first + k, r["id"], r["severity"], SEVERITIES[r["severity"]], r.get("mitre_tactic", ""), r.get("mitre_technique", ""), r.get("service", ""), r["name"], " OR ".join(f"eventName={n}" for n in names_of(r)), r.get("description"))
        for k, r in enumerate(rules)
    ]
    return events.sparkSession.createDataFrame(rows, RULE_COLUMNS)
