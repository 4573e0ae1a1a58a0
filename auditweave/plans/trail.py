"""Audit events derived from the driver's ``events`` table, alike in Spark and in DuckDB.

The derivation is one SELECT; what the two engines spell differently is filled in. It meets every rule's
names and payloads, has bursts within minutes, logins from elsewhere, and addresses and identities that are shared,
and leaves some fields null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.plans.catalogue import RULES
from auditweave.sources.ingest import from_events

#: Names that no rule has, for searches and profiles.
PLAIN = ["DescribeInstances", "GetBucketAcl", "ListBuckets", "DecodeMessage"]
NAMES = sorted({name for rule in RULES for name in rule.names}) + PLAIN + ["DeleteRole", "RemoveTags", "DestroyStack"]
BUSY = ["RunInstances", "StopInstances", "TerminateInstances", "StartInstances", "GetSecretValue", "DeleteBucket", "ListUsers"]
PAYLOADS = [
    '{"userName":"user7"}', '{"policyArn":"arn:aws:iam::aws:policy/AdministratorAccess"}', '{"policyArn":"*"}', '{"setAsDefault":true}',
    '{"roleArn":"arn:aws:iam::111111111111:role/r"}', '{"roleArn":"arn:aws:iam::100000000001:role/r"}', '{"name":"t","s3BucketName":null}',
    '{"DistributionConfig":{"Logging":{"Enabled":false}}}', '{"attributes":{"KmsMasterKeyId":""}}', '{"attributeName":"KmsMasterKeyId","attributeValue":""}',
    '{"bucketPolicy":{"Statement":[{"Principal":"*"}]}}', '{"AccessControlPolicy":"http://acs.amazonaws.com/groups/global/AllUsers"}', '{"BucketLoggingStatus":{}}',
    '{"cidrIp":"0.0.0.0/0"}', '{"cidr":"::/0","ruleAction":"deny"}', '{"cidr":"0.0.0.0/0","ruleAction":"allow"}', '{"mapPublicIpOnLaunch":{"value":true}}',
    '{"deletionProtection":false}', '{"publiclyAccessible":true}', '{"masterUserPassword":"x"}', '{"createVolumePermission":{"add":{"items":[{"group":"all"}]}}}',
    '{"userData":"x"}', '{"httpTokens":"optional"}', '{"principal":"*"}', '{"environment":{}}', '{"launchPermission":{"add":["all"]}}', '{"accountIds":["All"]}',
    '{"attributeName":"restore"}', '{"z":123456789012345678901234567890123456789012,"a":1e3,"n":1.50}', '{ "zone" : "é漢" , "list" : [1,  2.0], "a" : null }',
    '{"bucketName":"b*1","key":"k1"}',
]
#: A payload that meets the test of a name's rule; a fifth of the events with such a name carry it, so that each rule fires.
FITTING = {
    "CreateAccessKey": '{"userName":"someone"}', "CreatePolicyVersion": '{"setAsDefault":true}', "AssumeRole": '{"roleArn":"arn:aws:iam::999999999999:role/guest"}',
    "UpdateTrail": '{"name":"t","s3BucketName":"elsewhere"}', "SetTopicAttributes": '{"attributeName":"KmsMasterKeyId","attributeValue":""}',
    "SetQueueAttributes": '{"attributes":{"KmsMasterKeyId":""}}', "ModifySubnetAttribute": '{"subnetId":"s1","mapPublicIpOnLaunch":{"value":true}}', "ModifyDBCluster": '{"dbCluster":"d1","masterUserPassword":"new"}',
    "CreateLaunchTemplate": '{"name":"l1","userData":"run"}', "ModifyImageAttribute": '{"imageId":"i2","launchPermission":{"add":["all"]}}',
    "ModifyInstanceMetadataOptions": '{"instanceId":"i1","httpTokens":"optional"}',
}
#: Those denied a role, who come within a few minutes of a day, as do busy names of one identity.
DENIED = "(kind = 'error' AND k % 2 = 0 AND user_id % 4 = 3)"
REGIONS = ["us-east-1", "us-west-2", "eu-west-1", "ap-south-1"]

SELECT = """
SELECT record_id, record_id AS source_id,
  CASE WHEN kind = 'purchase' AND k < 90 AND user_id = 7 OR {denied} THEN ts_ms - ts_ms % 86400000 + (record_id * 7919) % 240000 ELSE ts_ms END AS ts_ms,
  CASE WHEN kind = 'view' THEN 'GetObject' WHEN kind = 'signup' THEN 'ConsoleLogin' WHEN {denied} THEN 'AssumeRole'
       WHEN kind = 'purchase' THEN {busy} ELSE {name} END AS event_name,
  CASE WHEN kind = 'view' THEN 's3.amazonaws.com' WHEN kind = 'signup' THEN 'signin.amazonaws.com' ELSE 'ec2.amazonaws.com' END AS event_source,
  {region} AS aws_region,
  CASE WHEN kind = 'signup' AND k % 10 = 7 THEN '198.51.' || CAST((user_id * 7 + 13) % 100 AS {text}) || '.9' WHEN k = 99 THEN NULL WHEN k = 98 THEN '10.0.0.' || CAST(user_id % 200 AS {text})
       ELSE '198.51.' || CAST(user_id % 100 AS {text}) || '.' || CAST(record_id % 2 AS {text}) END AS source_ip,
  CASE WHEN user_id % 3 = 0 THEN 'cli/2.1' WHEN user_id % 3 = 1 THEN 'Console, "web"' ELSE NULL END AS user_agent,
  CASE WHEN k IN (0, 50) OR record_id % 41 = 5 THEN 'Root' WHEN user_id % 2 = 0 THEN 'IAMUser' ELSE 'AssumedRole' END AS identity_type,
  'P' || CAST(user_id AS {text}) AS principal_id,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'arn:aws:iam::10000000000' || CAST(user_id % 3 AS {text}) || ':user/u' || CAST(user_id AS {text}) END AS user_arn,
  '10000000000' || CAST(user_id % 3 AS {text}) AS account_id,
  CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'user' || CAST(user_id AS {text}) END AS user_name,
  CASE WHEN kind = 'error' AND k % 2 = 0 THEN 'AccessDenied' WHEN kind = 'error' AND k % 5 = 0 THEN 'ThrottlingException' ELSE NULL END AS error_code,
  CASE WHEN kind = 'view' THEN CASE WHEN k % 25 = 24 THEN NULL ELSE '{{"bucketName":"bucket' || CAST(k % 7 AS {text}) || '","key":"key' || CAST(record_id % 40 AS {text}) || '"}}' END
       WHEN k % 20 = 19 THEN NULL WHEN record_id % 5 = 1 THEN {fitting} ELSE {payload} END AS request_parameters,
  CASE WHEN kind = 'signup' THEN CASE WHEN k % 3 = 0 THEN '{{"ConsoleLogin":"Failure"}}' ELSE '{{"ConsoleLogin":"Success"}}' END ELSE NULL END AS response_elements,
  CASE WHEN kind = 'signup' THEN CASE WHEN k % 2 = 0 THEN '{{"MFAUsed":"Yes"}}' ELSE '{{"MFAUsed":"No"}}' END
       WHEN kind = 'view' AND k % 10 <> 9 THEN '{{"bytesTransferredOut":' || CAST(k * 1000 AS {text}) || '.7}}' ELSE NULL END AS additional_event_data,
  CASE WHEN kind = 'view' THEN CASE WHEN k % 25 = 24 THEN NULL ELSE 'bucket' || CAST(k % 7 AS {text}) END
       WHEN k % 20 <> 19 AND record_id % 5 <> 1 AND {place} = {bucket_at} THEN 'b*1' ELSE NULL END AS bucket_name,
  k % 2 = 0 AS read_only
FROM ({source}) AS raw
"""


def listed(values: list[str], index: str, spark: bool) -> str:
    """SQL for the ``index``-th (from 0) of ``values``."""
    quoted = ", ".join("'" + value + "'" for value in values)
    return f"element_at(array({quoted}), CAST({index} AS INT) + 1)" if spark else f"([{quoted}])[CAST({index} AS INT) + 1]"


def derivation(source: str, spark: bool) -> str:
    place = f"(record_id * 13 + k) % {len(PAYLOADS)}"
    named = f"(record_id * 7 + k * 31 + user_id) % {len(NAMES)}"
    return SELECT.format(
        busy=listed(BUSY, f"(record_id + k) % {len(BUSY)}", spark), name=listed(NAMES, named, spark), fitting=listed([FITTING.get(name, PAYLOADS[0]) for name in NAMES], named, spark),
        region=listed(REGIONS, f"user_id % {len(REGIONS)}", spark), payload=listed(PAYLOADS, place, spark), place=place, bucket_at=len(PAYLOADS) - 1,
        text="STRING" if spark else "VARCHAR", source=source, denied=DENIED,
    )


#: Two thirds of the reads and of the busy names come from one identity, a third of the others from four.
SPARK_SOURCE = "SELECT event_id AS record_id, unix_millis(CAST(ts AS TIMESTAMP)) AS ts_ms, CASE WHEN event_type IN ('view', 'purchase') AND event_id % 3 < 2 THEN 7 WHEN event_id % 3 = 0 THEN user_id % 4 + 6 ELSE user_id END AS user_id, event_type AS kind, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}"
#: DuckDB: a CTE that oracle SQL starts with. Its epoch_ms rounds where Spark floors, hence epoch_us.
DUCKDB_SOURCE = "SELECT event_id AS record_id, epoch_us(ts) // 1000 AS ts_ms, CASE WHEN event_type IN ('view', 'purchase') AND event_id % 3 < 2 THEN 7 WHEN event_id % 3 = 0 THEN user_id % 4 + 6 ELSE user_id END AS user_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"
TRAIL = f"trail AS ({derivation(DUCKDB_SOURCE, spark=False)})"


def trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table of the driver's data at ``sf_dir``."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = raw.select("event_id", "ts", "user_id", "event_type", "props")
    raw.createOrReplaceTempView("auditweave_raw_events")
    derived = spark.sql(derivation(SPARK_SOURCE.replace("{events}", "auditweave_raw_events"), spark=True))
    shown = derived.withColumn("event_time", F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return from_events(shown.drop("source_id"))
