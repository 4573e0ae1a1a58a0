from __future__ import annotations

import random

import pytest

from auditweave.operators import search
from auditweave.operators.search import FieldTest as Is
from auditweave.sources import export
from tests.audit import event, table

NOW = 1_700_000_000_000


@pytest.mark.parametrize(("text", "groups"), [
    ("", []), ("eventName=Get", [[Is("eventName", "exact", "Get")]]), ("eventName!=Get*", [[Is("eventName", "prefix", "get", True)]]),
    ("eventName=*Tail", [[Is("eventName", "suffix", "tail")]]), ("eventName=*Mid*", [[Is("eventName", "contains", "mid")]]),
    ("eventName=***", [[Is("eventName", "contains", "*")]]), ("arn=*", [[Is("arn", "exists", "")]]), ("arn=**", [[Is("arn", "exists", "")]]),
    ("a=b plain eventName=x and userName=y", [[Is("eventName", "exact", "x"), Is("userName", "exact", "y")]]),
    ("eventName=x or OR userName=y", [[Is("eventName", "exact", "x")], [Is("userName", "exact", "y")]]),
    ('userAgent="two words"', [[Is("userAgent", "exact", "two words")]]), ("userName=a=b", [[Is("userName", "exact", "a=b")]]),
    ("NOT eventName=x", [[Is("eventName", "exact", "x")]]), ("(eventName=x)", []),
])
def test_notation(text, groups):
    assert search.parse(text, NOW).groups == groups


def test_times():
    read = search.parse("earliest=-2h latest=now earliest=-1d", NOW)
    assert (read.earliest, read.latest) == (NOW - 86_400_000, NOW)
    assert search.parse("earliest=123").earliest == 123
    assert search.parse("latest=1970-01-01T00:00:01+00:00").latest == 1000
    for bad in ("earliest=soon", "earliest=-5", "latest=-5y", "latest=2024-01-01T00:00:00"):
        with pytest.raises(ValueError):
            search.parse(bad)
    assert search.preset("6h", NOW) == (NOW - 21_600_000, NOW)


def test_strict_refuses_what_is_passed_over():
    for text in ("nosuch=1", "NOT eventName=x", "plain"):
        with pytest.raises(ValueError):
            search.parse(text, strict=True)


def test_a_search_and_its_negation_are_everything(spark):
    rng = random.Random(1)
    rows = [event(k, rng.choice(["GetObject", "getobject", "PutObject"]), user_name=rng.choice([None, "ann", "Bob*%_"]), error_code=rng.choice([None, "AccessDenied"])) for k in range(60)]
    events = table(spark, rows).cache()
    for test in ("eventName=GetObject", "eventName=GET*", "userName=*ob*", "userName=*b*%_*", "errorCode=*", "userName=ann"):
        negated = test.replace("=", "!=", 1)
        held, rest = search.search(events, test).count(), search.search(events, negated).count()
        assert held + rest == 60 and held
    assert search.search(events, "userName!=ann").where("user_name IS NULL").count() == sum(r is None for r in [row[13] for row in rows])


def test_bounds_are_inclusive_and_global(spark):
    events = table(spark, [event(k, "A" if k % 2 else "B") for k in range(10)])
    lo, hi = NOW + 2 * 60_000, NOW + 5 * 60_000
    found = search.search(events, f"eventName=A OR eventName=B earliest={lo} latest={hi}")
    assert sorted(r.record_id for r in found.collect()) == [2, 3, 4, 5]


def test_pages(spark):
    events = table(spark, [event(k, minute=k // 3) for k in range(20)])
    ids = [r.record_id for n in range(4) for r in search.page(events, n, 6).collect()]
    assert ids == list(range(20))
    last = search.page(events, 0, 6).collect()[-1]
    assert [r.record_id for r in search.page_after(events, last.ts_ms, last.record_id, 6).collect()] == [6, 7, 8, 9, 10, 11]
    assert search.page(events, 0, 10_000, 5).count() == 5


def test_composition(spark):
    events = table(spark, [event(1, "A", aws_region="x"), event(2, "A", aws_region="y"), event(3, "B", aws_region="x"), event(4, "B", aws_region="y")])

    def ids(**options):
        return sorted(r.record_id for r in events.where(search.predicate(search.compose("eventName=A OR eventName=B", {"awsRegion": "x"}, **options))).collect())

    assert ids() == [1, 3]
    assert ids(compat=True) == [1, 2, 3]


def test_name_test_is_pushed_to_the_scan(spark, tmp_path, capsys):
    table(spark, [event(k) for k in range(5)]).write.parquet(f"{tmp_path}/events")
    found = search.list_rows(search.search(spark.read.parquet(f"{tmp_path}/events"), "eventName=GetObject earliest=5"))
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(event_name,GetObject)" in plan and "GreaterThanOrEqual(ts_ms,5)" in plan
    assert "request_parameters" not in plan


def test_dates_prune_partitions(spark, tmp_path, capsys):
    from auditweave.sources.export import write_table

    write_table(table(spark, [event(k, minute=k * 1440) for k in range(5)]), f"{tmp_path}/events")
    events = spark.read.parquet(f"{tmp_path}/events")
    found = search.search(events, f"earliest={NOW + 86_400_000} latest={NOW + 3 * 86_400_000}")
    assert sorted(r.record_id for r in found.collect()) == [1, 2, 3]
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "event_date" in plan.split("PartitionFilters")[1].splitlines()[0]


def test_case_is_folded_in_ascii_only(spark):
    rows = spark.createDataFrame([(1, "\u00c9TOILE"), (2, "\u00e9toile"), (3, "Etoile")], "record_id long, user_name string")
    found = {text: sorted(r.record_id for r in rows.where(search.predicate(search.parse(text))).collect()) for text in ("userName=*TOI*", "userName=\u00c9to*", "userName=*ILE")}
    assert found == {"userName=*TOI*": [1, 2, 3], "userName=\u00c9to*": [1], "userName=*ILE": [1, 2, 3]}


def test_a_page_sorts_only_the_days_that_hold_it(spark, tmp_path):
    rows = [event(k, minute=(k * 37 % 101) * 97) for k in range(101)]  # a week
    events = table(spark, rows)
    export.write_table(events, f"{tmp_path}/table")
    dated = spark.read.parquet(f"{tmp_path}/table")
    for number in (0, 3, 10, 11):
        want = [r.record_id for r in search.page(events, number, 10).collect()]
        for source in (events, dated):
            assert [r.record_id for r in search.page_of_days(source, number, 10).collect()] == want
    third = search.page_of_days(dated, 3, 10)
    assert dated.select("event_date").distinct().count() >= 7 and third.select("event_date").distinct().count() <= 2
    plan = third._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and ">= 2023-" in plan and "<= 2023-" in plan
    assert search.page_of_days(events.limit(0)).count() == 0
