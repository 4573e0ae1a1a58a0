"""The audit event: columns of the events table, and the JSON that delivered files hold."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, BOOL = T.StringType(), T.LongType(), T.BooleanType()

RESOURCE = T.StructType([T.StructField("account_id", STRING), T.StructField("type", STRING), T.StructField("arn", STRING)])

#: Column, type.
COLUMNS: list[tuple[str, T.DataType]] = [
    ("record_id", LONG), ("ts_ms", LONG), ("event_time", STRING), ("event_source", STRING), ("event_name", STRING),
    ("aws_region", STRING), ("source_ip", STRING), ("user_agent", STRING), ("identity_type", STRING),
    ("principal_id", STRING), ("user_arn", STRING), ("account_id", STRING), ("access_key_id", STRING),
    ("user_name", STRING), ("invoked_by", STRING), ("session_context", STRING), ("request_parameters", STRING),
    ("response_elements", STRING), ("additional_event_data", STRING), ("error_code", STRING), ("error_message", STRING),
    ("request_id", STRING), ("event_id", STRING), ("shared_event_id", STRING), ("event_type", STRING),
    ("event_category", STRING), ("recipient_account_id", STRING), ("read_only", BOOL), ("management_event", BOOL),
    ("session_credential_from_console", STRING), ("resources", T.ArrayType(RESOURCE)), ("bucket_name", STRING),
]

EVENTS = T.StructType([T.StructField(name, kind) for name, kind in COLUMNS])

#: Path in a delivered record of each column that is read as text.
PATHS = {
    "event_time": "eventTime", "event_source": "eventSource", "event_name": "eventName", "aws_region": "awsRegion",
    "source_ip": "sourceIPAddress", "user_agent": "userAgent", "identity_type": "userIdentity.type",
    "principal_id": "userIdentity.principalId", "user_arn": "userIdentity.arn", "account_id": "userIdentity.accountId",
    "access_key_id": "userIdentity.accessKeyId", "user_name": "userIdentity.userName",
    "invoked_by": "userIdentity.invokedBy", "session_context": "userIdentity.sessionContext",
    "request_parameters": "requestParameters", "response_elements": "responseElements",
    "additional_event_data": "additionalEventData", "error_code": "errorCode", "error_message": "errorMessage",
    "event_id": "eventID", "event_type": "eventType", "event_category": "eventCategory",
    "recipient_account_id": "recipientAccountId", "session_credential_from_console": "sessionCredentialFromConsole",
}

#: Searchable names and their columns; aliases follow their canonical name.
FIELDS = {
    "eventName": "event_name", "eventSource": "event_source", "awsRegion": "aws_region", "region": "aws_region",
    "sourceIPAddress": "source_ip", "sourceIp": "source_ip", "userArn": "user_arn", "arn": "user_arn",
    "userName": "user_name", "accountId": "account_id", "errorCode": "error_code", "identityType": "identity_type",
    "userIdentity.type": "identity_type", "userAgent": "user_agent", "bucketName": "bucket_name",
}

#: The facets of the filter panel, in its order.
FACETS = ["userName", "sourceIPAddress", "userAgent", "eventName", "eventSource", "awsRegion", "errorCode", "identityType", "bucketName"]
