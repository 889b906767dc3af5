"""Connection-record schema, column roles, feature sets and label dictionaries."""

from __future__ import annotations

from pyspark.sql import types as T

# Field order and role of each field in a connection record.
_CONNECTION_FIELDS = """
duration numeric
protocol_type nominal
service nominal
flag nominal
src_bytes numeric
dst_bytes numeric
land binary
wrong_fragment numeric
urgent numeric
hot numeric
num_failed_logins numeric
logged_in binary
num_compromised numeric
root_shell binary
su_attempted binary
num_root numeric
num_file_creations numeric
num_shells numeric
num_access_files numeric
num_outbound_cmds numeric
is_host_login binary
is_guest_login binary
count numeric
srv_count numeric
serror_rate numeric
srv_serror_rate numeric
rerror_rate numeric
srv_rerror_rate numeric
same_srv_rate numeric
diff_srv_rate numeric
srv_diff_host_rate numeric
dst_host_count numeric
dst_host_srv_count numeric
dst_host_same_srv_rate numeric
dst_host_diff_srv_rate numeric
dst_host_same_src_port_rate numeric
dst_host_srv_diff_host_rate numeric
dst_host_serror_rate numeric
dst_host_srv_serror_rate numeric
dst_host_rerror_rate numeric
dst_host_srv_rerror_rate numeric
"""

# The 14 numeric fields of the reduced feature set, in order.
_REDUCED_FIELDS = """
dst_bytes wrong_fragment count serror_rate srv_serror_rate srv_rerror_rate
same_srv_rate dst_host_count dst_host_srv_count dst_host_same_srv_rate
dst_host_diff_srv_rate dst_host_serror_rate dst_host_srv_serror_rate
dst_host_rerror_rate
"""

# Attack names per category.
ATTACKS_BY_CATEGORY = {
    "DoS": "back land neptune pod smurf teardrop mailbomb apache2 processtable udpstorm",
    "Probe": "ipsweep nmap portsweep satan mscan saint",
    "R2L": "ftp_write guess_passwd imap multihop phf spy warezclient warezmaster "
           "sendmail named snmpgetattack snmpguess xlock xsnoop worm",
    "U2R": "buffer_overflow loadmodule perl rootkit httptunnel ps sqlattack xterm",
}

NORMAL = "normal"
UNKNOWN = "unknown"

ROLES: dict[str, str] = dict(
    line.split() for line in _CONNECTION_FIELDS.strip().splitlines()
)
FEATURES: tuple[str, ...] = tuple(ROLES)
FEATURES_14: tuple[str, ...] = tuple(_REDUCED_FIELDS.split())
FEATURES_16: tuple[str, ...] = ("service", "flag", *FEATURES_14)
FEATURE_SETS: dict[int, tuple[str, ...]] = {
    14: FEATURES_14,
    16: FEATURES_16,
    41: FEATURES,
}

LABEL = "labels"
LABEL_NUMERIC = "labels_numeric"

FINE_LABELS: dict[str, str] = {NORMAL: NORMAL} | {
    attack: category
    for category, names in ATTACKS_BY_CATEGORY.items()
    for attack in names.split()
}

CONNECTION_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType() if role == "nominal" else T.DoubleType())
        for name, role in ROLES.items()
    ]
    + [
        T.StructField(LABEL, T.StringType()),
        T.StructField(LABEL_NUMERIC, T.DoubleType()),
    ]
)

ATTACK_TYPE_SCHEMA = T.StructType(
    [
        T.StructField("attack", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)

FIELD_ROLE_SCHEMA = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("kind", T.StringType())]
)

FRAME_SCHEMA = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("idx", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("linktype", T.IntegerType()),
        T.StructField("caplen", T.IntegerType()),
        T.StructField("len", T.IntegerType()),
        T.StructField("frame", T.BinaryType()),
    ]
)


def feature_columns(features: int | list[str] | tuple[str, ...]) -> list[str]:
    """Column names of a feature set given as its size (14, 16, 41) or as a list."""
    if isinstance(features, int):
        if features not in FEATURE_SETS:
            raise ValueError(f"feature set must be one of {sorted(FEATURE_SETS)}")
        return list(FEATURE_SETS[features])
    return list(features)


def columns_with_role(
    columns: list[str] | tuple[str, ...],
    role: str,
    roles: dict[str, str] | None = None,
) -> list[str]:
    """Those of ``columns`` that have the given role, in their order."""
    roles = ROLES if roles is None else roles
    return [c for c in columns if roles.get(c) == role]
