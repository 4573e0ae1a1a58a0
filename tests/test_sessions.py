from __future__ import annotations

import random
import re
from itertools import pairwise

import pytest

from auditweave.operators import correlate, detect, session_store, sessions
from auditweave.plans.catalogue import RULES
from tests.audit import event, table


def test_gaps(spark):
    for gap, n in ((29, 1), (30, 1), (30.001, 2), (31, 2)):
        marked = sessions.session_events(table(spark, [event(1, minute=0), event(2, minute=gap)]))
        assert sessions.sessions(marked).count() == n, gap


def test_random_sessions_match_brute_force(spark):
    rng = random.Random(2)
    rows = [event(k, rng.choice("ABC"), minute=rng.randrange(0, 6000), source_ip=rng.choice([None, "198.51.100.1"]), user_arn=rng.choice([None, "x"]), user_name=None, error_code=rng.choice([None, "E"])) for k in range(400)]
    marked = sessions.session_events(table(spark, rows))
    found = {(r.identity, r.ip, r.first_ms, r.last_ms, r.events, r.errors, tuple(r.names)) for r in sessions.sessions(marked).collect()}
    want = set()
    for who in ("x", "P1"):
        for ip in ("unknown", "198.51.100.1"):
            mine = sorted((r[1], r[0], r) for r in rows if (r[10] or "P1") == who and (r[6] or "unknown") == ip)
            group = []
            for item in [*mine, None]:
                if group and (item is None or item[0] - group[-1][0] > 1_800_000):
                    names = tuple(dict.fromkeys(g[2][4] for g in group))
                    want.add((who, ip, group[0][0], group[-1][0], len(group), sum(g[2][19] is not None for g in group), names))
                    group = []
                if item:
                    group.append(item)
    assert found == want
    assert sum(r[4] for r in found) == 400


def test_lists_and_detail(spark):
    rows = [event(1, "A", minute=0), event(2, "B", minute=1, error_code="E"), event(3, "A", minute=500), event(4, "A", minute=2, source_ip="203.0.113.9")]
    marked = sessions.session_events(table(spark, rows))
    found = sessions.sessions(marked).cache()
    assert [r.events for r in sessions.list_sessions(found, order="events").collect()][0] == 2
    assert sessions.list_sessions(found, ip="203.").count() == 1
    assert sessions.list_sessions(found, who="ANN", start=rows[2][1]).count() == 1
    longest = sessions.list_sessions(found, order="duration").first()
    assert [r.record_id for r in sessions.detail(found, marked, longest.session_id).collect()] == [1, 2]
    assert [r.number for r in sessions.numbered(found).orderBy("number").collect()] == [0, 1, 2]
    assert sessions.sessions(sessions.session_events(table(spark, []))).count() == 0


def test_correlation(spark):
    events = table(spark, [event(1, "StopLogging", minute=0), event(2, "DeleteTrail", minute=1), event(3, minute=2), event(4, "CreateUser", minute=300)])
    marked = sessions.session_events(events)
    found = detect.alert_events(events, [r for r in RULES if not r.burst])
    touching = {(r.rule_id, r.events) for r in correlate.alerts_of_session(marked, found).collect()}
    assert touching == {("DE-01", 2), ("PE-01", 1)}
    assert correlate.sessions_of_alert(sessions.sessions(marked), marked, found, "DE-01").count() == 1


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def rows_of(frame):
    return sorted(map(str, frame.collect()))


def shuffles(frame) -> int:
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def days_of_events(spark, n: int):
    """Events of few identities over days, one session of them longer than two days."""
    rng = random.Random(5)
    rows = [event(k, rng.choice(["StopLogging", "CreateUser", "A"]), minute=rng.randrange(0, 12_000), user_arn=rng.choice([None, "x", "y"]), source_ip=rng.choice([None, "198.51.100.1"]), error_code=rng.choice([None, "E"])) for k in range(n)]
    return table(spark, rows + [event(n + k, "DeleteTrail", minute=20 * k, user_arn="long", request_parameters=None) for k in range(150)])


def test_stored_sessions_equal_those_of_events(spark):
    events = days_of_events(spark, 600)
    store = session_store.Store(events, "kept", 3)
    marked = sessions.session_events(events)
    found = sessions.sessions(marked)
    assert rows_of(store.sessions().select(*found.columns)) == rows_of(found)
    assert max(r.duration_ms for r in found.collect()) > 2 * sessions.DAY_MS
    plain = [r for r in RULES if not r.burst]
    alerts = correlate.alerts_of_session(marked, detect.alert_events(events, plain))
    assert rows_of(store.alerts_of_sessions().select(*alerts.columns)) == rows_of(alerts)
    assert store.events().count() == 750 and store.events().agg({"day_events": "max"}).first()[0] == 72
    store.drop()
    none = session_store.Store(events.limit(0), "empty", 2)
    assert none.sessions().count() == none.events().count() == none.alerts_of_sessions().count() == 0
    none.drop()


def test_stored_sessions_shuffle_no_events(spark, no_broadcast):
    """Marks, parts, the rules in them and the joins among these need no exchange; sessions one of parts."""
    store = session_store.Store(days_of_events(spark, 50), "laid", 3)
    for frame in (sessions.facts(store.marks, session_store.PART), store.events(), store.alert_parts()):
        assert shuffles(frame) == 0
    # Finding the marks moves a row a key and day only: to its key, and back to its day.
    lines = sessions.marked(store.dealt)._jdf.queryExecution().executedPlan().toString().split("\n")
    moved = [below for line, below in pairwise(lines) if "Exchange " in line]
    assert moved and all("Aggregate(" in below or re.search(r"Project \[identity#\d+, ip#\d+, session_day#\d+L, __(prior|carry)#\d+L?\]", below) for below in moved)
    assert shuffles(store.sessions()) <= 4  # parts and first occurrences by session, then their join
    store.drop()


def test_detail_marks_only_the_events_of_its_key(spark, tmp_path):
    """The conditions on identity and address reach the scans whose events are marked."""
    rows = [event(k, minute=k % 20, source_ip=f"198.51.100.{k % 3}") for k in range(60)]
    table(spark, rows).write.parquet(str(tmp_path / "events"))
    marked = sessions.session_events(spark.read.parquet(str(tmp_path / "events")))
    found = sessions.bounds(marked)
    assert {r.session_id for r in found.collect()} == {r.session_id for r in sessions.sessions(marked).collect()}
    shown = sessions.detail(found, marked, found.where("ip = '198.51.100.1'").first().session_id)
    assert {r.record_id for r in shown.collect()} == {k for k in range(60) if k % 3 == 1}
    plan = shown._jdf.queryExecution().optimizedPlan().toString().splitlines()
    scans = [k for k, line in enumerate(plan) if "Relation [" in line]
    # The other one gives the last time of each key and day.
    held = ["Filter" in plan[k - 1] and "198.51.100.1)" in plan[k - 1] for k in scans]
    assert sum(held) == len(held) - 1 == 3, held
    assert sessions.detail(found, marked, "none").count() == 0
