from __future__ import annotations

import gzip
import io
import json
import random
import zipfile
from functools import partial

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from auditweave.operators import detect, objects, stats
from auditweave.plans import queries
from auditweave.sources import archives, export, ingest
from auditweave.streaming import live
from tests.audit import event, table

RECORD = {
    "eventTime": "2024-03-01T10:00:00Z", "eventSource": "s3.amazonaws.com", "eventName": "GetObject", "awsRegion": "eu-west-1", "sourceIPAddress": "198.51.100.1",
    "userIdentity": {"type": "IAMUser", "arn": "arn:aws:iam::1:user/a", "userName": "a", "sessionContext": {"x": 1}}, "requestID": "r1", "eventID": "e1", "readOnly": True,
    "requestParameters": {"bucketName": "b", "key": "k"}, "additionalEventData": {"bytesTransferredOut": 7.9}, "resources": [{"ARN": "arn:x", "accountId": "1", "type": "T"}],
}


def delivered(*records) -> bytes:
    return json.dumps({"Records": list(records)}).encode()


def test_loading(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / "one.json").write_bytes(delivered(RECORD, RECORD | {"eventTime": "2024-03-01"}))
    (deep / "two.log.gz").write_bytes(gzip.compress(delivered(RECORD | {"sourceIPAddress": None})))
    (deep / "odd.log").write_bytes(gzip.compress(delivered(RECORD)))
    (deep / "plain.JSON.GZ").write_bytes(delivered(RECORD))
    (tmp_path / "export.json").write_text(json.dumps({"Events": [{"EventId": "1", "CloudTrailEvent": json.dumps(RECORD)}, {"CloudTrailEvent": json.dumps(RECORD)}]}))
    with zipfile.ZipFile(tmp_path / "pack.zip", "w") as archive:
        archive.writestr("in/x.json", delivered(RECORD))
        archive.writestr("in/y.json.gz", gzip.compress(delivered(RECORD, RECORD)))
        archive.writestr("in/z.json", delivered(RECORD | {"eventName": 42}))
        archive.writestr("readme.txt", "no log")
    (tmp_path / "bad.json").write_bytes(delivered(RECORD, {k: v for k, v in RECORD.items() if k != "awsRegion"}))
    (tmp_path / "torn.json.gz").write_bytes(gzip.compress(delivered(RECORD))[:40])
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    (tmp_path / "text.log").write_text("not json")
    (tmp_path / "other.json").write_text('{"Other": []}')
    (tmp_path / "skipped.txt").write_bytes(delivered(RECORD))

    loaded = ingest.load(ingest.find_files(spark, str(tmp_path)))
    events, warnings = loaded
    counts = {r.path.rsplit("/", 1)[1]: r.records for r in stats.load_report(events).collect()}
    assert counts == {r.path.rsplit("/", 1)[1]: r.records for r in loaded.report.collect()}
    assert counts == {"one.json": 2, "two.log.gz": 1, "odd.log": 1, "plain.JSON.GZ": 1, "export.json": 2, "pack.zip": 3}
    told = {(r.path.rsplit("/", 1)[1], r.entry): r.error.split(":")[0] for r in warnings.collect()}
    assert told == {("pack.zip", 2): "json", ("bad.json", 0): "json", ("torn.json.gz", 0): "gzip", ("broken.zip", 0): "zip", ("text.log", 0): "json", ("other.json", 0): "json"}
    row = events.where("path like '%odd.log'").first()
    assert (row.ts_ms, row.bucket_name, row.request_id, row.read_only, row.session_context) == (1_709_287_200_000, "b", "r1", True, '{"x": 1}')
    assert row.resources[0].arn == "arn:x" and json.loads(row.request_parameters) == {"bucketName": "b", "key": "k"}
    summary = stats.source_summary(events).first()
    assert (summary.files, summary.events, summary.earliest_ms) == (6, 10, 1_709_287_200_000)
    assert events.select("record_id").distinct().count() == 10
    single, _ = ingest.load(ingest.find_files(spark, str(tmp_path / "skipped.txt"), single=True))
    assert single.count() == 1

    apart = ingest.load(ingest.find_files(spark, str(tmp_path), archives=False), archives.read(spark, str(tmp_path), task_bytes=1))
    columns = [c for c in events.columns if c not in ("path", "record_id")]
    for one, other in ((events.select(columns), apart.events.select(columns)), (warnings.drop("path"), apart.warnings.drop("path")), (loaded.report.drop("path"), apart.report.drop("path"))):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_large_units_and_records(spark, tmp_path):
    """Units of 140 MB, and a record of that size."""
    pad = json.dumps("x" * (1 << 20))[1:-1]
    small = RECORD | {"requestID": "r2"}
    wide = [RECORD | {"requestParameters": {"key": pad}}] * 140
    (tmp_path / "delivery.json.gz").write_bytes(gzip.compress(delivered(*wide), 1))
    (tmp_path / "export.json.gz").write_bytes(gzip.compress(json.dumps({"Events": [{"EventId": "1", "CloudTrailEvent": json.dumps(r)} for r in wide]}).encode(), 1))
    (tmp_path / "other.json.gz").write_bytes(gzip.compress(json.dumps({"Records": [RECORD, small], "Other": [pad] * 140}).encode(), 1))
    (tmp_path / "late.json.gz").write_bytes(gzip.compress(json.dumps({"Other": [pad] * 140, "Records": [small, small | {"eventName": 42}]}).encode(), 1))
    (tmp_path / "one.json.gz").write_bytes(gzip.compress(delivered(RECORD | {"requestParameters": [pad] * 140}), 1))
    loaded = ingest.load(ingest.find_files(spark, str(tmp_path)))
    found = loaded.events.groupBy("path").agg(F.count("*").alias("n"), F.max(F.length("request_parameters")).alias("wide"))
    assert {r.path.rsplit("/", 1)[1]: (r.n, r.wide > 1 << 20) for r in found.collect()} == {"delivery.json.gz": (140, True), "export.json.gz": (140, True), "other.json.gz": (2, False), "one.json.gz": (1, True)}
    assert [(r.path.rsplit("/", 1)[1], r.error) for r in loaded.warnings.collect()] == [("late.json.gz", ingest.UNFIT)]


def test_records_are_cut_alike_at_any_chunk(monkeypatch):
    records = [{"a": [1, -2.5e+3, True, None, "]},{\\\" ü漢😀"]}, {}, 17, "text", [[]], {"b": {"c": "\\ud83d\\ude00"}}]
    texts = {
        json.dumps({"Records": records}, ensure_ascii=False): records,
        json.dumps({"x": {"Records": [0]}, "Records": records, "Events": [1]}, indent=2): records,
        json.dumps({"y": [1], "Records": records, "Other": None}): records,
        '{"Records": [ ]} ': [], '{"Records":[{"a":1,"a":2}]}': [{"a": 2}],
    }
    wrong = ["", '{"Records":[1,]}', '{"Records":[1]', '{"Records":[1]} rest', '{"Records":[NaN]}', '{"Records":[1] "x":2}', "not json", '{"Records":["']
    for size in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(ingest, "CHUNK", size)
        for packing in (bytes, gzip.compress):
            for text, wanted in texts.items():
                opened = partial(io.BytesIO, packing(text.encode()))
                found = [part for name, part in ingest.elements(ingest.chunks_of(opened)) if name == "Records"]
                assert found[0] is None and [json.loads(part) for part in found[1:]] == wanted
            for text in wrong:
                assert list(ingest.records_of("a.json", packing(text.encode())))[-1][5] == "json: not a JSON document", text


def units(text: str, **more) -> list[tuple]:
    """(kind, layout, pos, error) of the rows of a unit."""
    return [(row[0], row[3], row[4], row[5]) for row in ingest.records_of("a.json", text.encode(), **more)]


def test_layouts_and_fallback():
    good, nested = json.dumps(RECORD), json.dumps({"EventId": "1", "CloudTrailEvent": json.dumps(RECORD)})
    records, events = [("record", "Records", 0, None)], [("record", "Events", 0, None)]
    missing = "json: no Records in the document"

    def unit(n, error=None):
        return [("unit", None, n, error)]

    assert units(f'{{"Records":[{good}],"Events":[1]}}') == records + unit(1)
    assert units(f'{{"Events":[{nested}]}}') == events + unit(1)
    # A record that does not fit, a member that is no array, one that comes twice: the other layout counts.
    assert units(f'{{"Records":[{good},{{"eventName":1}}],"Events":[{nested}]}}') == records + [("void", "Records", None, None)] + events + unit(1)
    for bad in ("null", "{}", '[1]', f'[],"Records":[{good}]'):
        assert units(f'{{"Records":{bad},"Events":[{nested}]}}')[-2:] == events + unit(1)
        assert units(f'{{"Records":{bad},"Events":[{nested},{{}}]}}')[-1:] == unit(0, ingest.UNFIT)
    assert units(f'{{"Events":[{nested}],"Events":[]}}')[-1:] == unit(0, ingest.UNFIT)
    for other in ("[1]", "12", "{}", '{"Other":[]}'):
        assert units(other) == unit(0, missing)
    assert units('{"Records":[],"Events":[1]}') == unit(0)
    # Broken text behind good records rejects them too.
    assert units(f'{{"Records":[{good}],') == records + [("void", "Records", None, None)] + unit(0, "json: not a JSON document")
    assert units(f'{{"Records":[{good},1,{good}]}}', lenient=True) == [*records, ("record", "Records", 1, None), *unit(2)]


def fields(text: str) -> dict:
    return dict(zip([name for name, _ in ingest.GIVEN], ingest.fields_of(text), strict=True))


def with_members(members: str) -> str:
    return json.dumps(RECORD)[:-1] + "," + members + "}"


PAYLOADS = ['{"z":1,"a":2}', '{ "b" : [1,\n 2] }', "123456789012345678901234567890123456789012", "1e3", "1.50", '"a text"', '"\\u00e9 \\" /"', '{"a":1,"a":2,"b":{"c":[],"c":1}}', "[]", "true"]


@pytest.mark.parametrize("payload", PAYLOADS)
def test_payloads_stay_as_delivered(payload):
    found = fields(with_members(f'"responseElements" : {payload} '))
    assert found["response_elements"] == payload
    whole = json.dumps({k: v for k, v in RECORD.items() if k != "userIdentity"})
    found = fields(f'{whole[:-1]},"userIdentity":{{"sessionContext":{payload},"type":"x"}}}}')
    assert (found["session_context"], found["identity_type"]) == (payload, "x")


@pytest.mark.parametrize("members", ['"eventName":"twice"', '"requestParameters":{}', '"userIdentity":{}', '"resources":[]'])
def test_known_members_come_once(members):
    with pytest.raises(ingest.Unfit):
        ingest.fields_of(with_members(members))


def test_other_members_are_passed_over():
    found = fields(with_members('"x":1,"x":[{"eventName":"inner"}],"sharedEventID":5,"requestId":"small"'))
    assert (found["event_name"], found["shared_event_id"], found["request_id"]) == ("GetObject", None, "r1")
    assert fields(with_members('"responseElements":null'))["response_elements"] is None


@pytest.mark.parametrize("wrong", [{"eventName": None}, {"awsRegion": 1}, {"userIdentity": None}, {"userIdentity": {"arn": 1}}, {"readOnly": "yes"}, {"errorCode": []}, {"resources": None}, {"resources": [1]}, {"resources": [{"ARN": 1}]}, {"userAgent": "\ud800"}])
def test_wrong_types_do_not_fit(wrong):
    with pytest.raises(ingest.Unfit):
        ingest.fields_of(json.dumps(RECORD | wrong))


def test_exported_payloads_stay_as_they_are(spark):
    rows = [event(k, rp=payload, session_context=payload, resources=[("1", "T", "arn:x")]) for k, payload in enumerate([*PAYLOADS, None, "no json"])]
    lines = {r.record_id: r.line for r in export.full_json(table(spark, rows)).collect()}
    for k, payload in enumerate(PAYLOADS):
        shown = payload.replace("\n", " ")
        assert f'"requestParameters":{shown}}}' in lines[k] and f'"sessionContext":{shown}}},' in lines[k]
        assert json.loads(lines[k])["resources"] == [{"accountId": "1", "type": "T", "ARN": "arn:x"}]
    assert all("requestParameters" not in json.loads(lines[k]) for k in (len(PAYLOADS), len(PAYLOADS) + 1))


def test_units_are_decoded_once(spark, tmp_path, monkeypatch):
    for k in range(6):
        (tmp_path / f"{k}.json").write_bytes(delivered(*[RECORD] * 3, *[{"eventName": 1}] * (k == 2)))
    calls = spark.sparkContext.accumulator(0)
    kept = ingest.records_of

    def counted(path, content, lenient=False):
        calls.add(1)
        yield from kept(path, content, lenient)

    monkeypatch.setattr(ingest, "records_of", counted)
    loaded = ingest.load(ingest.find_files(spark, str(tmp_path)))
    assert loaded.events.count() == 15 and loaded.warnings.count() == 1 and loaded.report.count() == 5
    assert calls.value == 6
    assert "MapInArrow" not in loaded.events._jdf.queryExecution().executedPlan().toString()


def test_archives_are_read_by_entry(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        for k in range(12):
            archive.writestr(f"{k}.json", delivered(*[RECORD | {"requestID": f"r{k}"}] * (k + 1)))
        archive.writestr("notes.txt", "no log")
    with zipfile.ZipFile(tmp_path / "torn.zip", "w") as archive:
        for k in range(5):
            archive.writestr(f"{k}.json", delivered(RECORD))
    torn = (tmp_path / "torn.zip").read_bytes().replace(b"GetObject", b"PutObject", 1)  # the sum of one entry is wrong
    (tmp_path / "torn.zip").write_bytes(torn)
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    rows = archives.read(spark, str(tmp_path), task_bytes=1)
    assert rows.rdd.getNumPartitions() == 12 + 5 + 1
    loaded = ingest.load(None, rows)
    assert {r.path.rsplit("/", 1)[1]: r.records for r in loaded.report.collect()} == {"many.zip": 78}
    assert {(r.entry, r.n) for r in loaded.events.groupBy("entry").agg(F.count("*").alias("n")).collect()} == {(k, k + 1) for k in range(12)}
    assert sorted((r.path.rsplit("/", 1)[1], r.entry, r.error.split(":")[0]) for r in loaded.warnings.collect()) == [("broken.zip", 0, "zip"), ("torn.zip", 0, "zip")]
    one = archives.read(spark, str(tmp_path / "many.zip"))
    assert one.rdd.getNumPartitions() == 1 and ingest.load(None, one).events.count() == 78
    empty = tmp_path / "none"
    empty.mkdir()
    assert ingest.load(None, archives.read(spark, str(empty))).events.count() == 0


def test_only_folders_of_the_window_are_listed(spark, tmp_path):
    for year in (2023, 2024):
        for month in (1, 2, 12):
            for day in range(1, 29):
                folder = tmp_path / "logs" / "eu" / str(year) / f"{month:02}" / f"{day:02}"
                folder.mkdir(parents=True)
                (folder / "a.json").write_bytes(delivered(RECORD | {"eventTime": f"{year}-{month:02}-{day:02}T10:00:00Z"}))
    other = tmp_path / "logs" / "other" / "2024"
    other.mkdir(parents=True)
    (other / "x.json").write_bytes(delivered(RECORD))
    (tmp_path / "top.json").write_bytes(delivered(RECORD))
    start, end = 1_705_276_800_000, 1_705_449_600_001  # 2024-01-15 to 2024-01-17
    plain, seen = ingest.listing(spark), []

    def listed(folder):
        found = plain(folder)
        seen.extend(path for path, _ in found)
        return found

    folders = ingest.files_in_window(spark, str(tmp_path), start, end, listed)
    assert sorted(path.split(tmp_path.name)[1] for path in folders) == ["/logs/eu/2024/01/15", "/logs/eu/2024/01/16", "/logs/eu/2024/01/17", "/logs/other/2024/x.json", "/top.json"]
    # Of 168 day folders the 28 of one month are listed, and none of their files.
    assert not any("/eu/2023/" in path or path.endswith("a.json") for path in seen) and len(seen) < 45
    found = ingest.load(ingest.find_files(spark, str(tmp_path), start_ms=start, end_ms=end)).events
    assert found.count() == 5
    assert ingest.load(ingest.find_files(spark, str(tmp_path), start_ms=1_709_164_800_000)).events.count() == 28 + 2  # from 2024-02-29: December, and other layouts
    assert ingest.load(ingest.find_files(spark, str(tmp_path), end_ms=1_672_617_600_000)).events.count() == 1 + 1  # before 2023-01-02; folders of a year after it are left out whole


def test_keys_by_date(spark):
    keys = ["x/2024/03/01/a.json.gz", "x/2024/03/02/a.json", "x/2024/13/01/a.json.gz", "x/a.json.gz", "2024/03/03/b.log", "x/2024/03/01/a.txt", "x/2024/3/1/a.gz"]
    frame = spark.createDataFrame([(k,) for k in keys], "path string")
    day = 1_709_251_200_000  # 2024-03-01

    def kept(lo, hi):
        return {r.path for r in frame.where(ingest.in_window(F.col("path"), lo, hi)).collect()}

    assert kept(None, None) == set(keys) - {"x/2024/03/01/a.txt"}
    assert kept(day + 86_400_000, None) == set(keys) - {"x/2024/03/01/a.txt", "x/2024/03/01/a.json.gz", "x/2024/3/1/a.gz"}
    assert kept(day + 86_399_999, day + 86_400_000) == {"x/2024/03/01/a.json.gz", "x/2024/3/1/a.gz", "x/2024/13/01/a.json.gz", "x/a.json.gz"}


def test_writing(spark, tmp_path):
    rows = [event(2, "B", user_name='say "hi", now'), event(1, "A", user_name=None, rp={"a": [1, {"b": None}]}, error_code="line\nbreak")]
    events = table(spark, rows).withColumn("event_time", F.lit("t"))
    lines = [r.line for r in export.csv_lines(events).orderBy("ts_ms").collect()]
    assert lines[0].startswith("t,A,ec2.amazonaws.com,us-east-1,198.51.100.7,,arn:") and lines[0].endswith('"line\nbreak"')
    assert '"say ""hi"", now"' in lines[1]
    assert export.write_csv(events, f"{tmp_path}/csv") == 2
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{tmp_path}/csv").collect()
    assert {r.userName for r in back} == {None, 'say "hi", now'} and back[0].__fields__ == list(export.CSV_COLUMNS)
    assert export.write_json(events, f"{tmp_path}/json") == 2
    objects_ = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/json").collect()]
    assert objects_[0]["requestParameters"] == {"a": [1, {"b": None}]} and objects_[0]["userIdentity"]["arn"].endswith("ann")
    assert export.export_counts(events).first().rows == 2
    assert export.write_table(events, f"{tmp_path}/table") == 2
    assert spark.read.parquet(f"{tmp_path}/table").where("event_date = DATE'2023-11-14'").count() == 2


def test_object_summary(spark):
    def read(k, bucket, key, n, who="ann", **more):
        rp = {"bucketName": bucket, "key": key} if bucket else None
        return event(k, "GetObject", rp=rp, extra={"bytesTransferredOut": n}, bucket_name=bucket, user_arn=who, **more)

    rows = [read(1, "b", "x", 10), read(2, "b", "x", 5.9, "bob"), read(3, "b", "y", -3), read(4, "c", "x", 20, source_ip=None), read(5, None, None, 99), event(6, "PutObject", bucket_name="b")]
    reads = objects.object_reads(table(spark, rows)).cache()
    assert tuple(objects.totals(reads).first()) == (35, 5, 3)
    assert tuple(objects.totals(objects.select_reads(reads, bucket="b")).first()) == (15, 3, 2)
    assert tuple(objects.totals(objects.select_reads(reads, start=rows[1][1], end=rows[2][1])).first()) == (5, 2, 2)
    assert tuple(objects.totals(objects.select_reads(reads, identity="bob", ip="198.51.100.7")).first()) == (5, 1, 1)
    assert {tuple(r) for r in objects.by_bucket(reads).collect()} == {("b", 15, 3, "ann"), ("c", 20, 1, "ann")}
    assert [tuple(r) for r in objects.top_objects(reads, 2).collect()] == [("c", "x", 20, 1), ("b", "x", 15, 2)]
    assert {tuple(r) for r in objects.by_identity(reads).collect()} == {("ann", 30, 3, 2), ("bob", 5, 1, 1)}
    assert [tuple(r) for r in objects.choices(reads).collect()] == [("bucket", "b"), ("bucket", "c"), ("identity", "ann"), ("identity", "bob"), ("ip", "198.51.100.7")]
    assert tuple(objects.totals(objects.object_reads(table(spark, []))).first()) == (0, 0, 0)


def test_histogram_and_profile(spark):
    events = table(spark, [event(k, minute=m, user_name=None if k == 3 else "ann") for k, m in enumerate([0, 0.5, 9.99, 10])])
    found = stats.histogram(events, 5).collect()
    assert [r.events for r in sorted(found, key=lambda r: r.bucket)] == [2, 0, 0, 0, 2]
    assert stats.histogram(events.limit(0)).count() == 0
    one = stats.histogram(table(spark, [event(1), event(2, minute=1)])).collect()
    assert sum(r.events for r in one) == 2
    same = stats.histogram(table(spark, [event(1, minute=1), event(2, minute=1)])).collect()
    assert [(r.bucket, r.events, r.end_ms - r.start_ms) for r in same] == [(0, 2, 0)]
    who = "arn:aws:iam::123456789012:user/ann"
    assert stats.profile(events, who).first().events == 4 and stats.profile(events, "ann").first().events == 3
    assert stats.profile(events, "nobody").count() == 0
    assert tuple(stats.profile(events, who, 0, 1).first()) == (0, 0, 0, 0)
    assert stats.profile(events, who, 0).first().events == 4  # a range needs both bounds


def test_streams(spark, tmp_path):
    source, names = tmp_path / "in", ["alert_stream", "session_stream"]
    source.mkdir()
    times = ["10:00:00", "10:30:00", "11:00:01"]
    (source / "a.json").write_bytes(delivered(*[RECORD | {"eventName": "StopLogging", "eventTime": f"2024-03-01T{t}Z"} for t in times], {"eventName": 1}))
    (source / "b.json.gz").write_bytes(gzip.compress(delivered(RECORD | {"eventTime": "2024-03-03T00:00:00Z"})))
    events = live.file_stream(spark, str(source))
    for name, frame in zip(names, (live.stream_alert_events(events), live.stream_sessions(events)), strict=True):
        query = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination()
    assert [r.rule_id for r in spark.table("alert_stream").collect()] == ["DE-01"] * 3
    assert sorted(r.events for r in spark.table("session_stream").collect()) == [1, 2]
    assert detect.SAMPLE == 100


def test_a_lookup_event_without_its_record_rejects_the_unit(spark, tmp_path):
    good, bare = {"EventId": "1", "CloudTrailEvent": json.dumps(RECORD)}, {"EventId": "2", "EventName": "X"}
    (tmp_path / "bad.json").write_text(json.dumps({"Events": [good, bare]}))
    (tmp_path / "null.json").write_text(json.dumps({"Events": [good, {"CloudTrailEvent": None}]}))
    (tmp_path / "good.json").write_text(json.dumps({"Events": [good]}))
    events, warnings = ingest.load(ingest.find_files(spark, str(tmp_path)))
    assert [r.path.rsplit("/", 1)[1] for r in events.collect()] == ["good.json"]
    assert sorted((r.path.rsplit("/", 1)[1], r.error) for r in warnings.collect()) == [("bad.json", ingest.UNFIT), ("null.json", ingest.UNFIT)]


def test_files_in_parts(spark):
    """Parts are joined in order, by file, and what does not fit is rejected as with whole files; no row holds a file."""
    records = [json.dumps(RECORD | {"requestID": f"r{k}"}) for k in range(500)]
    good = ['{"Records":[' + records[0], *["," + r for r in records[1:]], "]}"]
    bad = ['{"Records":[{"eventName":1}]', ',"Events":[' + json.dumps({"CloudTrailEvent": records[0]}), "]}"]
    torn = ['{"Records":[', records[0]]
    rows = [(path, k, text) for path, parts in (("a", good), ("b", bad), ("c", torn)) for k, text in enumerate(parts)]
    parts = spark.createDataFrame(sorted(rows, key=lambda r: r[2]), "path string, k int, text string")
    loaded = ingest.load(None, ingest.decode_parts(parts, "k"))
    assert {r.path: r.records for r in loaded.report.collect()} == {"a": 500, "b": 1}
    assert [(r.path, r.error) for r in loaded.warnings.collect()] == [("c", "json: not a JSON document")]
    assert [r.request_id for r in loaded.events.where("path = 'a'").select("request_id", "record_id").collect() if r.request_id == "r499"] == ["r499"]

    busy = table(spark, [event(k, "StopLogging", minute=0, rp={"pad": "x" * 1000}) for k in range(300)])
    for made in (queries.in_parts(export.full_json(busy), F.lit("one"), F.col("line")), queries.in_parts(export.full_json(busy), F.lit("one"), F.col("line"), "Events")):
        assert made.agg(F.max(F.length("text"))).first()[0] < 3000
        assert len(json.loads("".join(r.text for r in made.orderBy("ts_ms", "record_id").collect()))) == 1


def test_parts_meet_whatever_spark_merges(spark):
    """Both sides of a union are dealt by path already, and only the partitions of the small one are merged."""
    record, order = json.dumps(RECORD), Window.partitionBy("path").orderBy("k")
    sides = [
        [(f"{k}", 0, '{"Events":[' + json.dumps({"CloudTrailEvent": record}) + "],") for k in range(40)],
        [(f"{k}", 1, f'"Other":"{random.Random(k).randbytes(100_000).hex()}","Records":[{record},{record}]}}') for k in range(40)],
    ]
    dealt = [spark.createDataFrame(rows, "path string, k int, text string").withColumn("k", F.col("k") + F.row_number().over(order)) for rows in sides]
    loaded = ingest.load(None, ingest.decode_parts(dealt[0].unionByName(dealt[1]), "k"))
    assert loaded.warnings.count() == 0
    assert {r.path: r.records for r in loaded.report.collect()} == {f"{k}": 2 for k in range(40)}


def test_written_files_keep_the_order_of_their_parts(spark, tmp_path):
    events = table(spark, [event(k, minute=k % 7 * 60 + k / 1000) for k in range(2000)])
    parts = queries.in_parts(export.full_json(events), F.expr("ts_ms div 3600000"), F.col("line"))
    queries.written(parts, str(tmp_path / "out"), "path")
    files = list((tmp_path / "out").rglob("part-*"))
    assert len(files) == parts.select("path").distinct().count()
    assert sum(len(json.loads(gzip.decompress(f.read_bytes()))["Records"]) for f in files) == 2000
