"""Events for the tests."""

from __future__ import annotations

import json

from auditweave.schema import COLUMNS, EVENTS


def event(record_id: int, name: str = "DescribeInstances", *, minute: float | None = None, rp=None, resp=None, extra=None, **fields):
    """One event; a minute apart by id unless said otherwise. Payloads may be given as objects."""

    def text(payload):
        return payload if payload is None or isinstance(payload, str) else json.dumps(payload, separators=(",", ":"))

    minute = record_id if minute is None else minute
    row = {name: None for name, _ in COLUMNS} | {
        "record_id": record_id, "ts_ms": 1_700_000_000_000 + int(minute * 60_000), "event_name": name, "event_source": "ec2.amazonaws.com",
        "aws_region": "us-east-1", "source_ip": "198.51.100.7", "identity_type": "IAMUser", "user_arn": "arn:aws:iam::123456789012:user/ann",
        "user_name": "ann", "account_id": "123456789012", "principal_id": "P1", "request_parameters": text(rp), "response_elements": text(resp),
        "additional_event_data": text(extra), "resources": [],
    } | fields
    return tuple(row[name] for name, _ in COLUMNS)


def table(spark, rows):
    return spark.createDataFrame(rows, EVENTS)
