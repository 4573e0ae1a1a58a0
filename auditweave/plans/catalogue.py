"""The detection rules as data.

``where`` is a predicate in SQL over the events table with four shorthands, which sql() writes out for Spark
or DuckDB: RP('x') - the request payload's text holds x; J(column, 'k') - a string member of a payload;
HAS(column, 'k') - the payload has the member; ARN5(x) - the account of an ARN."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Burst:
    """n events within minutes; key: actor, actor_or_ip, ip, or '' for all events together (then every burst
    counts, else the first of each key)."""

    key: str
    n: int
    minutes: int


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    tactic: str
    technique: str
    service: str
    title: str
    names: tuple[str, ...] = ()
    where: str = ""
    burst: Burst | None = None
    evidence: str = ""
    facts: tuple[str, ...] = ()

    def evidence_query(self) -> str:
        return self.evidence or " OR ".join(f"eventName={name}" for name in self.names)


#: The rule table; about is a user rule's own description.
RULE_COLUMNS = (
    "ordinal int, rule_id string, severity string, severity_rank int, mitre_tactic string, mitre_technique string, "
    "service string, title string, query string, about string"
)
SEVERITIES = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
C, H, M, L, I = SEVERITIES
OPEN = "(RP('0.0.0.0/0') OR RP('::/0'))"
POLICY = "J(request_parameters, 'policyDocument')"


def spaced(member: str, value: str) -> str:
    """A member with a value, with or without one space between."""
    return f"""(RP('"{member}":{value}') OR RP('"{member}": {value}'))"""


# Rule ids, names of events, severities, tactics, techniques, services and thresholds.
RULES = [
    Rule("IA-01", H, "Initial Access", "T1078.004", "IAM", "Console login without a second factor", ("ConsoleLogin",), "J(response_elements, 'ConsoleLogin') = 'Success' AND coalesce(J(additional_event_data, 'MFAUsed'), 'No') <> 'Yes'"),
    Rule("IA-03", C, "Initial Access", "T1078.004", "IAM", "Root account in use", (), "identity_type = 'Root'", evidence="identityType=Root", facts=("count",)),
    Rule("IA-04", H, "Initial Access", "T1110.001", "IAM", "Failed console logins from one address", ("ConsoleLogin",), "J(response_elements, 'ConsoleLogin') = 'Failure' AND source_ip IS NOT NULL", Burst("ip", 5, 10), facts=("offending_ips", "threshold")),
    Rule("PE-01", M, "Persistence", "T1136.003", "IAM", "User created", ("CreateUser",), facts=("count",)),
    Rule("PE-02", H, "Persistence", "T1098.001", "IAM", "Access key created for another user", ("CreateAccessKey",), "J(request_parameters, 'userName') <> '' AND user_name <> '' AND J(request_parameters, 'userName') <> user_name"),
    Rule("PE-03", M, "Persistence", "T1098", "IAM", "Console password created", ("CreateLoginProfile",)),
    Rule("PE-04", C, "Persistence", "T1098.003", "IAM", "Administrator policy granted", ("AttachUserPolicy", "AttachRolePolicy", "AttachGroupPolicy", "PutUserPolicy", "PutRolePolicy", "PutGroupPolicy"),
         f"""(contains(coalesce(J(request_parameters, 'policyArn'), ''), 'AdministratorAccess') OR coalesce(J(request_parameters, 'policyArn'), '') = '*' OR (contains(coalesce({POLICY}, ''), '"*"') AND contains(coalesce({POLICY}, ''), '"Effect":"Allow"')) OR contains(coalesce({POLICY}, ''), 'AdministratorAccess'))""",
         evidence="eventName=AttachUserPolicy OR eventName=AttachRolePolicy OR eventName=PutUserPolicy OR eventName=PutRolePolicy"),
    Rule("PE-05", H, "Persistence", "T1556.006", "IAM", "Second factor removed", ("DeactivateMFADevice", "DeleteVirtualMFADevice")),
    Rule("PE-06", M, "Persistence", "T1098.003", "IAM", "Policy version made the default", ("CreatePolicyVersion",), spaced("setAsDefault", "true")),
    Rule("PE-07", M, "Persistence", "T1098.001", "STS", "Role assumed in another account", ("AssumeRole",), "ARN5(J(request_parameters, 'roleArn')) <> '' AND account_id <> '' AND ARN5(J(request_parameters, 'roleArn')) <> account_id"),
    Rule("DE-01", C, "Defense Evasion", "T1562.008", "CloudTrail", "Audit trail stopped or changed", ("StopLogging", "DeleteTrail", "UpdateTrail"), facts=("count",)),
    Rule("DE-02", C, "Defense Evasion", "T1562.001", "GuardDuty", "Threat detector disabled", ("DeleteDetector", "StopMonitoringMembers", "DisassociateMembers")),
    Rule("DE-04", H, "Defense Evasion", "T1562.001", "Config", "Configuration recorder stopped", ("StopConfigurationRecorder", "DeleteConfigurationRecorder")),
    Rule("DE-05", C, "Defense Evasion", "T1562.008", "VPC", "Flow logs deleted", ("DeleteFlowLogs",)),
    Rule("DE-06", H, "Defense Evasion", "T1562.008", "CloudWatch", "Log group deleted", ("DeleteLogGroup",)),
    Rule("DE-07", H, "Defense Evasion", "T1562.008", "CloudTrail", "Trail sent to another bucket", ("UpdateTrail",), "HAS(request_parameters, 's3BucketName')"),
    Rule("DE-08", M, "Defense Evasion", "T1562.001", "EventBridge", "Event rule disabled", ("DisableRule",)),
    Rule("DE-09", H, "Defense Evasion", "T1562.001", "WAF", "Web access list deleted", ("DeleteWebACL", "DeleteWebAclV2")),
    Rule("DE-10", M, "Defense Evasion", "T1562.008", "CloudFront", "Distribution logging switched off", ("UpdateDistribution",), """(RP('"Enabled":false') OR RP('"enabled":false'))"""),
    Rule("DE-11", M, "Defense Evasion", "T1562.001", "SQS", "Queue encryption removed", ("SetQueueAttributes",), spaced("KmsMasterKeyId", '""')),
    Rule("DE-12", M, "Defense Evasion", "T1562.001", "SNS", "Topic encryption removed", ("SetTopicAttributes",), "RP('KmsMasterKeyId') AND " + spaced("attributeValue", '""')),
    Rule("DE-13", M, "Defense Evasion", "T1485", "Route53", "Hosted zone deleted", ("DeleteHostedZone",)),
    Rule("CA-02", H, "Credential Access", "T1555", "SecretsManager", "Many secrets read by one identity", ("GetSecretValue",), "", Burst("actor", 6, 10)),
    Rule("CA-04", M, "Credential Access", "T1556", "IAM", "Password policy changed", ("UpdateAccountPasswordPolicy",)),
    Rule("CA-05", C, "Credential Access", "T1078.004", "IAM", "Root console login", ("ConsoleLogin",), "identity_type = 'Root' AND J(response_elements, 'ConsoleLogin') = 'Success'"),
    Rule("CA-06", H, "Credential Access", "T1485", "KMS", "Key scheduled for deletion", ("ScheduleKeyDeletion",)),
    Rule("DI-02", M, "Discovery", "T1087.004", "IAM", "Identities enumerated", ("ListUsers", "ListRoles", "ListPolicies", "ListGroups", "GetAccountAuthorizationDetails", "ListAttachedUserPolicies", "ListAttachedRolePolicies"),
         evidence="eventName=ListUsers OR eventName=ListRoles OR eventName=ListPolicies OR eventName=ListGroups OR eventName=GetAccountAuthorizationDetails", facts=("count",)),
    Rule("DI-03", M, "Discovery", "T1580", "IAM", "Many refused calls by one identity", (), "error_code = 'AccessDenied'", Burst("actor_or_ip", 10, 10), "errorCode=AccessDenied", ("identities",)),
    Rule("EX-01", H, "Exfiltration", "T1537", "S3", "Bucket opened to the public", ("PutBucketPolicy", "PutBucketAcl"),
         """(RP('http://acs.amazonaws.com/groups/global/AllUsers') OR RP('http://acs.amazonaws.com/groups/global/AuthenticatedUsers') OR RP('"Principal":"*"') OR HAS(request_parameters, 'bucketPolicy'))"""),
    Rule("EX-02", M, "Exfiltration", "T1485", "S3", "Bucket deleted", ("DeleteBucket",)),
    Rule("EX-03", M, "Exfiltration", "T1530", "S3", "Many objects read by one identity", ("GetObject",), "", Burst("actor", 50, 5), facts=("identities", "total_bytes_out", "object_count")),
    Rule("EX-04", M, "Exfiltration", "T1562.008", "S3", "Bucket access log switched off", ("PutBucketLogging",), """(RP('"BucketLoggingStatus":{}') OR RP('"loggingEnabled":{}') OR (RP('BucketLoggingStatus') AND NOT RP('LoggingEnabled')))"""),
    Rule("EX-05", H, "Exfiltration", "T1537", "S3", "Bucket encryption removed", ("DeleteBucketEncryption",)),
    Rule("IM-01", H, "Impact", "T1496", "EC2", "Many instances started", ("RunInstances",), "", Burst("", 6, 10), facts=("total_run_instances",)),
    Rule("IM-02", C, "Impact", "T1485", "Multi", "Many resources destroyed by one identity", (), "(event_name LIKE 'Delete%' OR event_name LIKE 'Terminate%' OR event_name LIKE 'Destroy%' OR event_name LIKE 'Remove%')", Burst("actor", 11, 5), "eventName=Delete* OR eventName=Terminate* OR eventName=Destroy* OR eventName=Remove*", ("identities",)),
    Rule("IM-03", L, "Impact", "T1534", "SES", "Mail identity added", ("VerifyEmailIdentity", "CreateEmailIdentity", "VerifyDomainIdentity")),
    Rule("IM-04", H, "Impact", "T1489", "EC2", "Many instances stopped by one identity", ("StopInstances",), "", Burst("actor", 4, 5), facts=("identities",)),
    Rule("IM-05", C, "Impact", "T1485", "EC2", "Many instances terminated by one identity", ("TerminateInstances",), "", Burst("actor", 4, 5), facts=("identities",)),
    Rule("IM-06", M, "Impact", "T1496", "EC2", "Many instances resumed by one identity", ("StartInstances",), "", Burst("actor", 6, 5), facts=("identities",)),
    Rule("NW-01", H, "Defense Evasion", "T1562.007", "VPC", "Security group opened to all", ("AuthorizeSecurityGroupIngress",), OPEN),
    Rule("NW-02", M, "Defense Evasion", "T1562.007", "VPC", "Network list entry allows all", ("CreateNetworkAclEntry", "ReplaceNetworkAclEntry"), f"{OPEN} AND NOT " + spaced("ruleAction", '"deny"')),
    Rule("NW-03", I, "Defense Evasion", "T1562.007", "VPC", "Internet gateway added", ("CreateInternetGateway", "AttachInternetGateway")),
    Rule("NW-04", M, "Defense Evasion", "T1562.007", "VPC", "Route to everywhere", ("CreateRoute", "ReplaceRoute"), OPEN),
    Rule("NW-05", I, "Lateral Movement", "T1021", "VPC", "Network peering created", ("CreateVpcPeeringConnection",)),
    Rule("NW-06", L, "Defense Evasion", "T1562.007", "VPC", "Security group deleted", ("DeleteSecurityGroup",)),
    Rule("NW-07", M, "Defense Evasion", "T1562.007", "VPC", "Subnet hands out public addresses", ("ModifySubnetAttribute",), "RP('mapPublicIpOnLaunch') AND RP('\"value\":true')"),
    Rule("NW-08", L, "Impact", "T1485", "VPC", "Address gateway deleted", ("DeleteNatGateway",)),
    Rule("RDS-01", H, "Impact", "T1485", "RDS", "Database deletion protection removed", ("ModifyDBInstance", "ModifyDBCluster"), "RP('deletionProtection') AND RP('false')"),
    Rule("RDS-02", H, "Exfiltration", "T1537", "RDS", "Database restored for public access", ("RestoreDBInstanceFromDBSnapshot", "RestoreDBClusterFromSnapshot", "RestoreDBInstanceToPointInTime"), spaced("publiclyAccessible", "true"),
         evidence="eventName=RestoreDBInstanceFromDBSnapshot OR eventName=RestoreDBClusterFromSnapshot"),
    Rule("RDS-03", M, "Credential Access", "T1098", "RDS", "Database master password changed", ("ModifyDBInstance", "ModifyDBCluster"), "(RP('masterUserPassword') OR RP('MasterUserPassword'))"),
    Rule("EBS-01", H, "Defense Evasion", "T1486", "EBS", "Default volume encryption disabled", ("DisableEbsEncryptionByDefault",)),
    Rule("EBS-02", C, "Exfiltration", "T1537", "EBS", "Snapshot shared with all", ("ModifySnapshotAttribute",), "(RP('\"all\"') OR (RP('all') AND RP('add')))"),
    Rule("EBS-03", L, "Exfiltration", "T1537", "EBS", "Volume detached", ("DetachVolume",)),
    Rule("EBS-04", M, "Impact", "T1485", "EBS", "Snapshot deleted", ("DeleteSnapshot",)),
    Rule("EBS-05", M, "Impact", "T1486", "EBS", "Default volume key changed", ("ModifyEbsDefaultKmsKeyId",)),
    Rule("EC-01", H, "Execution", "T1059", "EC2", "Instance start script changed", ("ModifyInstanceAttribute",), "RP('userData')"),
    Rule("EC-02", M, "Persistence", "T1098.004", "EC2", "Key pair created", ("CreateKeyPair",)),
    Rule("EC-03", M, "Persistence", "T1059", "EC2", "Launch template with a start script", ("CreateLaunchTemplate", "CreateLaunchTemplateVersion"), "RP('userData')"),
    Rule("EC-04", H, "Credential Access", "T1552.005", "EC2", "Metadata tokens made optional", ("ModifyInstanceMetadataOptions",), "RP('httpTokens') AND RP('optional')"),
    Rule("EC-05", M, "Credential Access", "T1078.004", "EC2", "Instance password read", ("GetPasswordData",)),
    Rule("EC-06", H, "Lateral Movement", "T1098.004", "EC2", "Login key pushed to an instance", ("SendSSHPublicKey", "SendSerialConsoleSSHPublicKey")),
    Rule("EC-07", H, "Execution", "T1651", "SSM", "Command sent to instances", ("SendCommand",)),
    Rule("EC-08", M, "Defense Evasion", "T1078", "EC2", "Serial console enabled", ("EnableSerialConsoleAccess",)),
    Rule("LM-01", H, "Persistence", "T1098", "Lambda", "Function opened to all callers", ("AddPermission20150331v2",), """(RP('"principal":"*"') OR RP('"Principal":"*"') OR RP('principal: "*"'))"""),
    Rule("LM-02", L, "Persistence", "T1525", "Lambda", "Function environment changed", ("UpdateFunctionConfiguration20150331v2", "UpdateFunctionConfiguration"), "(RP('Environment') OR RP('environment'))", evidence="eventName=UpdateFunctionConfiguration20150331v2"),
    Rule("RS-01", H, "Exfiltration", "T1537", "EC2", "Image shared with all", ("ModifyImageAttribute",), "(RP('launchPermission') OR RP('LaunchPermission')) AND RP('all')"),
    Rule("RS-02", H, "Exfiltration", "T1537", "SSM", "Document shared with all", ("ModifyDocumentPermission",), "(RP('All') OR RP('\"all\"'))"),
    Rule("RS-03", H, "Exfiltration", "T1537", "RDS", "Database snapshot shared", ("ModifyDBSnapshotAttribute", "ModifyDBClusterSnapshotAttribute"), "(RP('all') OR RP('\"restore\"'))"),
]

#: The two rules on countries, which need place data.
GEO_RULES = [
    Rule("GEO-01", M, "Initial Access", "T1078", "IAM", "Identity seen in several countries", evidence="eventName=ConsoleLogin"),
    Rule("GEO-02", H, "Initial Access", "T1078.004", "IAM", "Console login from a new country", evidence="eventName=ConsoleLogin"),
]

SPARK = {
    "RP": r"contains(coalesce(request_parameters, ''), \1)", "J": r"get_json_object(\1, '$.\2')",
    "HAS": r"coalesce(array_contains(json_object_keys(\1), '\2'), false)", "ARN5": r"try_element_at(split(\1, ':'), 5)",
}
DUCKDB = {
    "RP": r"contains(coalesce(request_parameters, ''), \1)", "J": r"json_extract_string(\1, '$.\2')",
    "HAS": r"coalesce(list_contains(json_keys(\1), '\2'), false)", "ARN5": r"string_split(\1, ':')[5]",
}


def sql(where: str, dialect: dict[str, str]) -> str:
    """A predicate with its shorthands written out."""
    where = re.sub(r"\bRP\(('(?:[^'])*')\)", dialect["RP"], where)
    where = re.sub(r"\bJ\((\w+), '(\w+)'\)", dialect["J"], where)
    where = re.sub(r"\bHAS\((\w+), '(\w+)'\)", dialect["HAS"], where)
    return re.sub(r"\bARN5\(((?:[^()]|\([^()]*\))*)\)", dialect["ARN5"], where)


def predicate(rule: Rule, dialect: dict[str, str] = SPARK) -> str:
    """The whole predicate of a rule, name test first so that payloads are read for those names only."""
    names = f"event_name IN ({', '.join(repr(name) for name in rule.names)})" if rule.names else ""
    return " AND ".join(filter(None, [names, f"({sql(rule.where, dialect)})" if rule.where else ""]))
