"""Schemas and fixed wire values."""

from __future__ import annotations

# Labels of a session record by position, then decision and score.
FEATURE_LABELS = [
    "Time", "BufRate", "AvgBitrate", "JoinTime", "Asn", "City", "Country", "ConnType",
    "State", "Os", "Liveorvod", "ObjectId", "PlayerType", "InitBitrate", "InitCdn",
]
RECORD_LABELS = [*FEATURE_LABELS, "decision", "socre"]
REDUCED_LABELS = ["decision", "socre"]

# Topics, markers and separators of the wire format.
TOPIC_INTERNAL = "internal_groups"
TOPIC_EXTERNAL = "external_groups"
TOPIC_UPLOAD = "upload"
TOPIC_DECISION = "decision"
TOPIC_SUBSCRIBE = "subscribe"
TOPIC_SAMPLE = "sample"
TOPIC_ALIVE = "alive"
UNMATCHED_GROUP = "null"
RESET_DECISION = "random"
FIELD_SEPARATOR = "\t"
ORIGIN_MARK = ";From: "
DECISION_MARK = "DecisionMap"
LOAD_MARK = "LoadMap"
STRIPPED = ": \t\n\r\0\x0b"

# Positions and settings of the decision loop.
DEFAULT_GROUP_FIELD = 4
MANAGEMENT_LABELS = 2
BANDIT_SCALE = 1000.0
RESET_EVERY = 15

# DDL schemas.
UPDATE_JSON = "update string, group_id string, cluster_id string"
ASSIGNMENT_JSON = "GroupAssignment array<struct<GroupName: string, Cluster: string>>"
BEST_JSON = "random array<string>, best string, epsilon double"
MESSAGE = "value string, ts timestamp"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
RESULT = "frontend int, mode string, cost double"
