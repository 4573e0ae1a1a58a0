from __future__ import annotations

import ipaddress
import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from auditweave.functions.ip import ip_key, is_public
from auditweave.operators import custom_rules, detect, geo, stats
from auditweave.plans.catalogue import GEO_RULES, RULES
from tests.audit import event, table

OPEN = {"ipPermissions": {"cidrIp": "0.0.0.0/0"}}
ADMIN = {"policyArn": "arn:aws:iam::aws:policy/AdministratorAccess"}
ROOT = {"identity_type": "Root"}

#: Rule: events that fire, events that do not; each a name and keyword arguments.
CASES = {
    "IA-01": ([("ConsoleLogin", {"resp": {"ConsoleLogin": "Success"}, "extra": {"MFAUsed": "No"}}), ("ConsoleLogin", {"resp": {"ConsoleLogin": "Success"}})], [("ConsoleLogin", {"resp": {"ConsoleLogin": "Success"}, "extra": {"MFAUsed": "Yes"}}), ("ConsoleLogin", {"resp": {"ConsoleLogin": "Failure"}})]),
    "IA-03": ([("AnyName", ROOT)], [("AnyName", {})]),
    "PE-02": ([("CreateAccessKey", {"rp": {"userName": "bob"}})], [("CreateAccessKey", {"rp": {"userName": "ann"}}), ("CreateAccessKey", {"rp": {"userName": "bob"}, "user_name": None}), ("CreateAccessKey", {})]),
    "PE-04": ([("AttachUserPolicy", {"rp": ADMIN}), ("PutGroupPolicy", {"rp": {"policyDocument": '{"Effect":"Allow","Action":"*"}'}}), ("AttachRolePolicy", {"rp": {"policyArn": "*"}})], [("AttachUserPolicy", {"rp": {"policyArn": "arn:x/ReadOnly"}}), ("PutUserPolicy", {"rp": {"policyDocument": '{"Effect":"Deny","Action":"*"}'}})]),
    "PE-06": ([("CreatePolicyVersion", {"rp": {"setAsDefault": True}}), ("CreatePolicyVersion", {"rp": '{"setAsDefault": true}'})], [("CreatePolicyVersion", {"rp": {"setAsDefault": False}})]),
    "PE-07": ([("AssumeRole", {"rp": {"roleArn": "arn:aws:iam::999999999999:role/x"}})], [("AssumeRole", {"rp": {"roleArn": "arn:aws:iam::123456789012:role/x"}}), ("AssumeRole", {"rp": {"roleArn": "a:b:c"}})]),
    "DE-07": ([("UpdateTrail", {"rp": {"s3BucketName": None}})], [("UpdateTrail", {"rp": {"name": "t"}})]),
    "DE-10": ([("UpdateDistribution", {"rp": {"logging": {"Enabled": False}}})], [("UpdateDistribution", {"rp": {"logging": {"Enabled": True}}})]),
    "DE-11": ([("SetQueueAttributes", {"rp": {"KmsMasterKeyId": ""}})], [("SetQueueAttributes", {"rp": {"KmsMasterKeyId": "k"}})]),
    "DE-12": ([("SetTopicAttributes", {"rp": {"attributeName": "KmsMasterKeyId", "attributeValue": ""}})], [("SetTopicAttributes", {"rp": {"attributeName": "Policy", "attributeValue": ""}})]),
    "CA-05": ([("ConsoleLogin", ROOT | {"resp": {"ConsoleLogin": "Success"}})], [("ConsoleLogin", {"resp": {"ConsoleLogin": "Success"}}), ("ConsoleLogin", ROOT | {"resp": {"ConsoleLogin": "Failure"}})]),
    "EX-01": ([("PutBucketPolicy", {"rp": {"bucketPolicy": {}}}), ("PutBucketAcl", {"rp": {"x": "http://acs.amazonaws.com/groups/global/AllUsers"}}), ("PutBucketPolicy", {"rp": {"p": {"Principal": "*"}}})], [("PutBucketAcl", {"rp": {"x": "private"}})]),
    "EX-04": ([("PutBucketLogging", {"rp": {"BucketLoggingStatus": {}}}), ("PutBucketLogging", {"rp": {"BucketLoggingStatus": {"a": 1}}})], [("PutBucketLogging", {"rp": {"BucketLoggingStatus": {"LoggingEnabled": {"t": 1}}}})]),
    "NW-01": ([("AuthorizeSecurityGroupIngress", {"rp": OPEN}), ("AuthorizeSecurityGroupIngress", {"rp": {"c": "::/0"}})], [("AuthorizeSecurityGroupIngress", {"rp": {"c": "10.0.0.0/8"}})]),
    "NW-02": ([("CreateNetworkAclEntry", {"rp": {"c": "0.0.0.0/0", "ruleAction": "allow"}})], [("CreateNetworkAclEntry", {"rp": {"c": "0.0.0.0/0", "ruleAction": "deny"}}), ("ReplaceNetworkAclEntry", {"rp": {}})]),
    "NW-04": ([("CreateRoute", {"rp": {"d": "0.0.0.0/0"}})], [("CreateRoute", {"rp": {"d": "10.0.0.0/8"}})]),
    "NW-07": ([("ModifySubnetAttribute", {"rp": {"mapPublicIpOnLaunch": {"value": True}}})], [("ModifySubnetAttribute", {"rp": {"mapPublicIpOnLaunch": {"value": False}}})]),
    "RDS-01": ([("ModifyDBInstance", {"rp": {"deletionProtection": False}})], [("ModifyDBCluster", {"rp": {"deletionProtection": True}})]),
    "RDS-02": ([("RestoreDBInstanceToPointInTime", {"rp": {"publiclyAccessible": True}})], [("RestoreDBClusterFromSnapshot", {"rp": {"publiclyAccessible": False}})]),
    "RDS-03": ([("ModifyDBCluster", {"rp": {"masterUserPassword": "x"}})], [("ModifyDBCluster", {"rp": {}})]),
    "EBS-02": ([("ModifySnapshotAttribute", {"rp": {"g": "all"}}), ("ModifySnapshotAttribute", {"rp": {"add": {"x": "allow"}}})], [("ModifySnapshotAttribute", {"rp": {"remove": "x"}})]),
    "EC-01": ([("ModifyInstanceAttribute", {"rp": {"userData": "x"}})], [("ModifyInstanceAttribute", {"rp": {"name": "x"}})]),
    "EC-03": ([("CreateLaunchTemplate", {"rp": {"userData": "x"}})], [("CreateLaunchTemplateVersion", {"rp": {}})]),
    "EC-04": ([("ModifyInstanceMetadataOptions", {"rp": {"httpTokens": "optional"}})], [("ModifyInstanceMetadataOptions", {"rp": {"httpTokens": "required"}})]),
    "LM-01": ([("AddPermission20150331v2", {"rp": {"principal": "*"}})], [("AddPermission20150331v2", {"rp": {"principal": "s3"}})]),
    "LM-02": ([("UpdateFunctionConfiguration", {"rp": {"environment": {}}})], [("UpdateFunctionConfiguration", {"rp": {"memory": 1}})]),
    "RS-01": ([("ModifyImageAttribute", {"rp": {"launchPermission": {"add": "all"}}})], [("ModifyImageAttribute", {"rp": {"launchPermission": {"add": "9"}}}), ("ModifyImageAttribute", {"rp": "all"})]),
    "RS-02": ([("ModifyDocumentPermission", {"rp": {"ids": ["All"]}}), ("ModifyDocumentPermission", {"rp": {"ids": ["all"]}})], [("ModifyDocumentPermission", {"rp": {"ids": ["9"]}})]),
    "RS-03": ([("ModifyDBSnapshotAttribute", {"rp": {"v": "restore"}}), ("ModifyDBClusterSnapshotAttribute", {"rp": {"v": "all"}})], [("ModifyDBSnapshotAttribute", {"rp": {"v": "x"}})]),
}


def test_the_catalogue():
    assert len(RULES) == 68 and len(GEO_RULES) == 2
    assert len({r.rule_id for r in RULES + GEO_RULES}) == 70


@pytest.fixture(scope="module")
def fired(spark):
    """Rules by event, for all cases in one run."""
    rows, at = [], {}
    plain = [r for r in RULES if not r.burst]
    for rule in plain:
        good, bad = CASES.get(rule.rule_id, ([(name, {}) for name in rule.names], [("Other" + rule.names[0] if rule.names else "Other", {})]))
        for fires, group in ((True, good), (False, bad)):
            for name, fields in group:
                at[len(rows)] = (rule.rule_id, fires)
                rows.append(event(len(rows), name, **fields))
    found = {(r.record_id, r.rule_id) for r in detect.alert_events(table(spark, rows), plain).collect()}
    return at, found


@pytest.mark.parametrize("rule_id", [r.rule_id for r in RULES if not r.burst])
def test_rule(fired, rule_id):
    at, found = fired
    mine = {k: fires for k, (r, fires) in at.items() if r == rule_id}
    assert True in mine.values() and False in mine.values()
    for k, fires in mine.items():
        assert ((k, rule_id) in found) == fires, k


BURSTS = {
    "IA-04": ("ConsoleLogin", {"resp": {"ConsoleLogin": "Failure"}}), "CA-02": ("GetSecretValue", {}), "DI-03": ("Anything", {"error_code": "AccessDenied"}), "EX-03": ("GetObject", {}),
    "IM-01": ("RunInstances", {}), "IM-02": ("DeleteThing", {}), "IM-04": ("StopInstances", {}), "IM-05": ("TerminateInstances", {}), "IM-06": ("StartInstances", {}),
}


@pytest.mark.parametrize("rule_id", sorted(BURSTS))
def test_burst_rule(spark, rule_id):
    rule = next(r for r in RULES if r.rule_id == rule_id)
    name, fields = BURSTS[rule_id]
    n, minutes = rule.burst.n, rule.burst.minutes

    def ids(count, apart, **more):
        rows = [event(k, name, minute=k * apart, **(fields | more)) for k in range(count)]
        return {r.record_id for r in detect.burst_events(table(spark, rows), [rule]).where(f"rule_id = '{rule_id}'").collect()}

    assert ids(n, minutes / (n - 1) / 2) == set(range(n))
    assert ids(n - 1, 0.01) == set()
    assert ids(n, minutes * 2) == set()
    if rule_id == "IA-04":
        assert ids(n, 0.1, source_ip=None) == set()


def test_alerts(spark):
    rows = [event(k, "CreateUser") for k in range(150)] + [event(200 + k, "ConsoleLogin", minute=500 + k, resp={"ConsoleLogin": "Failure"}) for k in range(6)] + [event(300, "StopLogging")]
    events = table(spark, rows)
    alerts = {r.rule_id: r for r in detect.run(events).collect()}
    assert set(alerts) == {"PE-01", "IA-04", "DE-01"}
    assert list(alerts) == ["DE-01", "IA-04", "PE-01"]
    assert alerts["PE-01"].matching_count == 150 and alerts["PE-01"].matching_record_ids == list(range(100))
    assert alerts["IA-04"].query == 'eventName=ConsoleLogin sourceIPAddress="198.51.100.7"' and alerts["IA-04"].offenders == ["198.51.100.7"]
    assert "150" in alerts["PE-01"].description
    shown = detect.evidence(events, alerts["IA-04"].query)
    assert shown.count() == 6
    ranged = {r.rule_id: r.matching_count for r in detect.run(events, start=rows[0][1], end=rows[9][1]).collect()}
    assert ranged == {"PE-01": 10}
    groups = [(r.severity, r.alerts) for r in stats.alert_groups(detect.run(events), "severity").collect()]
    assert groups == [("critical", 1), ("high", 1), ("medium", 1)]
    facts = {r.rule_id: r.metadata for r in detect.metadata(detect.alert_events(events), events, RULES).collect()}
    assert facts["PE-01"] == {"count": "150"} and facts["IA-04"] == {"offending_ips": "198.51.100.7", "threshold": "5"}
    assert detect.run(table(spark, [])).count() == 0


def test_download_burst_metadata(spark):
    rows = [event(k, "GetObject", minute=k * 0.01, bucket_name="b", rp={"bucketName": "b", "key": "x"}, extra={"bytesTransferredOut": 10.9}) for k in range(50)]
    events = table(spark, rows)
    facts = {r.rule_id: r.metadata for r in detect.metadata(detect.alert_events(events), events, RULES).collect()}
    assert facts["EX-03"] == {"identities": "arn:aws:iam::123456789012:user/ann", "total_bytes_out": "500", "object_count": "50"}


def test_custom_rules(spark):
    good, errors = custom_rules.validate(custom_rules.STARTERS)
    assert len(good) == 5 and not errors
    base = {"id": "X", "name": "x", "severity": "low", "match": {"event_name": "A"}}
    assert custom_rules.validate([base, base])[0] == []
    assert custom_rules.validate([base | {"id": ""}])[0] == []
    assert custom_rules.validate([base | {"match": {"event_name": []}}])[0] == []
    assert custom_rules.validate([base | {"threshold": {"min_count": 0}}])[0] == []
    assert custom_rules.validate([base | {"severity": "LOW"}, base | {"id": "Y"}])[0] == []
    assert custom_rules.validate([base, base | {"id": "Y", "filters": {"field": "nosuch", "value": "x"}}])[0] == []
    assert [r["id"] for r in custom_rules.validate([base, base | {"id": "Y"}, base | {"id": "Y"}])[0]] == ["X"]

    events = table(spark, [event(k, "A" if k % 2 else "B", aws_region="x" if k < 5 else "y", error_code=None if k % 3 else "E") for k in range(12)])

    def ids(**more):
        return sorted(r.record_id for r in custom_rules.alert_events(events, [base | more]).collect())

    assert ids() == [1, 3, 5, 7, 9, 11]
    assert ids(enabled=False) == []
    assert ids(match={"event_name": ["A", "B", "A"]}) == list(range(12))
    assert ids(filters={"not": {"field": "error_code", "value": "E"}}) == [1, 5, 7, 11]
    assert ids(filters={"and": [{"field": "region", "value": "x"}, {"or": [{"field": "error_code", "value": "E"}, {"field": "user_name", "value": "nobody"}]}]}) == [3]
    assert len(ids(threshold={"min_count": 3, "window_minutes": 4})) == 6
    assert ids(threshold={"min_count": 3, "window_minutes": 3}) == []
    assert len(ids(threshold={"min_count": 6})) == 6 and ids(threshold={"min_count": 7}) == []
    alert = {r.rule_id: r for r in detect.run(events, custom=[base | {"threshold": {"min_count": 2, "window_minutes": 2}}]).collect()}["X"]
    assert alert.matching_count == 6 and alert.query == "eventName=A"


def places(spark):
    def key_of(text):
        ip = ipaddress.ip_address(text)
        return f"{ip.version}{int(ip):032x}"

    rows = [("198.51.0.0", "198.51.127.255", "AA", 1), ("198.51.128.0", "198.52.255.255", "BB", 0), ("2001:db8::", "2001:db8:ffff::", "CC", 3)]
    return spark.createDataFrame([(key_of(a), key_of(b), c, f"name {c}", None, 1.0, 2.0, n, f"org {c}") for a, b, c, n in rows], "start_key string, end_key string, country_code string, country_name string, city string, lat double, lon double, asn int, asn_org string")


def test_addresses(spark):
    ips = ["198.51.0.0", "198.51.127.255", "198.51.128.0", "198.53.0.0", "10.1.2.3", "127.0.0.1", "not an ip", "2001:db8::7", "::1", "fe80::1", None, "198.52.1.1"]
    events = table(spark, [event(k, source_ip=ip) for k, ip in enumerate(ips)])
    known = places(spark)
    found = {r.source_ip: r.country_code for r in geo.enrich(events, known, known).collect()}
    assert found == {"198.51.0.0": "AA", "198.51.127.255": "AA", "198.51.128.0": "BB", "198.53.0.0": None, "2001:db8::7": "CC", "fe80::1": None, "198.52.1.1": "BB"}
    listed = geo.list_ips(stats.ip_counts(events), geo.enrich(events, known, known), order="country").collect()
    assert [r.country_code for r in listed][:5] == ["AA", "AA", "BB", "BB", "CC"] and len(listed) == 11


def test_address_keys(spark):
    rng = random.Random(4)
    texts = ["::", "::1", "0:0:0:0:0:0:0:1", "1::", "::ffff:1.2.3.4", "1:2:3:4:5:6:7.8.9.10", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::8::9", ":::", "1:2", ":1:2:3:4:5:6:7", "12345::", "g::", "", "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", "::1.2.3.400", "1.2.3.4::", "FE80::ABC", " 1.2.3.4", "172.15.0.1", "172.16.0.1", "172.31.9.9", "172.32.0.0", "192.168.0.1", "255.255.255.255", "0.0.0.0", "0.0.0.1", "169.254.3.4", "127.9.9.9", "10.0.0.0", "11.0.0.0", "1:2:3:4:5:6:7:8:9", "::1:2:3:4:5:6:7:8"]
    for _ in range(300):
        parts = [f"{rng.randrange(1 << rng.choice([4, 16])):x}" for _ in range(rng.choice([8, 8, 7, 3]))]
        cut = rng.randrange(len(parts))
        texts += [":".join(parts), ":".join(parts[:cut]) + "::" + ":".join(parts[cut:]), ".".join(str(rng.randrange(280)) for _ in range(4))]

    def wanted(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return None, False
        nets = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "255.255.255.255/32", "0.0.0.0/32")
        skipped = ip.is_loopback or ip.is_unspecified if ip.version == 6 else any(ip in ipaddress.ip_network(net) for net in nets)
        return f"{ip.version}{int(ip):032x}", not skipped

    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("key", ip_key("t"))
    for r in frame.withColumn("public", is_public(F.col("t"), F.col("key"))).collect():
        assert (r.key, r.public) == wanted(r.t), r.t


def test_range_join_of_crowded_addresses(spark):
    """All addresses in one /12, most in one /64; ranges of all lengths, one over everything at the end."""
    rng = random.Random(7)
    ips = [f"2001:db8:{rng.randrange(3) * (rng.random() < 0.2):x}::{rng.randrange(1 << 16):x}:{rng.randrange(1 << 16):x}" for _ in range(3000)]
    bounds = sorted(rng.sample(range(1 << 32), 400))
    base = int(ipaddress.ip_address("2001:db8::"))
    ranges = [(base + a, base + b - (k % 2), k) for k, (a, b) in enumerate(pairwise(bounds)) if k % 3] + [(base + (1 << 33), base + (1 << 100), 999)]
    table_ = spark.createDataFrame([(f"6{a:032x}", f"6{b:032x}", k) for a, b, k in ranges], "start_key string, end_key string, nth int")
    found = geo.public_ips(table(spark, [event(k, source_ip=ip) for k, ip in enumerate(ips)]))
    sizes = [r["count"] for r in geo.in_order(found, table_, ["nth"]).groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    want = {}
    for ip in ips:
        at = int(ipaddress.ip_address(ip))
        want |= {ip: k for a, b, k in ranges if a <= at <= b}
    assert {r.source_ip: r.nth for r in geo.in_ranges(found, table_, ["nth"]).collect()} == want


def test_alerts_in_one_pass(spark):
    rng = random.Random(2)
    rows = [(f"R{rng.randrange(3)}", rng.randrange(500), rng.randrange(10_000), rng.choice([None, "", *(f"k{j}" for j in range(30))])) for _ in range(2000)]
    found = spark.createDataFrame(rows, "rule_id string, record_id long, ts_ms long, key string").repartition(7)
    for r in detect.summaries(found, 10).collect():
        mine = [x for x in rows if x[0] == r.rule_id]
        assert (r.matching_count, r.first_ms, r.last_ms) == (len(mine), min(x[2] for x in mine), max(x[2] for x in mine))
        assert r.matching_record_ids == sorted(x[1] for x in mine)[:10] and r.offenders == sorted({x[3] for x in mine if x[3]})[:10]
    assert detect.summaries(found.limit(0)).count() == 0


def test_evidence_is_narrowed_in_every_alternative(spark):
    rows = [event(k, "DeleteRole", minute=k * 0.01) for k in range(6)] + [event(10 + k, "TerminateFleet", minute=k * 0.01) for k in range(6)]
    rows += [event(30, "DeleteRole", user_arn="arn:other"), event(31, "RemoveTags", user_arn="arn:other")]
    alert = {r.rule_id: r for r in detect.run(table(spark, rows)).collect()}["IM-02"]
    assert alert.query.count(" OR ") >= 3 and alert.query.count('arn="arn:aws:iam::123456789012:user/ann"') == alert.query.count(" OR ") + 1
    assert {r.record_id for r in detect.evidence(table(spark, rows), alert.query).collect()} == {*range(6), *range(10, 16)}
    flagged = detect.flagged(table(spark, rows), detect.alert_events(table(spark, rows)), "IM-02")
    assert flagged.count() == alert.matching_count


def test_geo_rules(spark):
    rows = [
        event(1, source_ip="198.51.0.1"), event(2, source_ip="198.52.0.1"), event(3, source_ip="10.0.0.1"),
        event(4, "ConsoleLogin", source_ip="2001:db8::1"), event(5, "ConsoleLogin", source_ip="198.51.0.2"),
        event(6, "ConsoleLogin", source_ip="198.51.0.1", user_arn="only-logins"),
    ]
    found = {(r.rule_id, r.record_id) for r in detect.geo_alert_events(table(spark, rows), places(spark)).collect()}
    assert found == {("GEO-01", 1), ("GEO-01", 2), ("GEO-01", 4), ("GEO-01", 5), ("GEO-02", 4)}
    alerts = {r.rule_id for r in detect.run(table(spark, rows), places(spark)).collect()}
    assert {"GEO-01", "GEO-02"} <= alerts
