"""Name lists and rules of the flow-statistics path: label names, identifier columns, feature groups."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Columns that identify a flow and never become features.
IDENTIFIER_COLUMNS = [
    "flow id", "flow_id", "flowid",
    "source ip", "source_ip", "src ip", "src_ip", "srcip", "sourceip",
    "destination ip", "destination_ip", "dst ip", "dst_ip", "dstip", "destinationip",
    "source port", "source_port", "src port", "src_port", "srcport", "sourceport",
    "destination port", "destination_port", "dst port", "dst_port", "dstport", "destinationport",
    "protocol", "timestamp", "time_stamp", "time stamp", "date",
    "mac", "src mac", "dst mac", "source mac", "destination mac",
]

# Accepted label names of task l1 (is the flow DoH).
L1_NAMES = {
    "non_doh": ["non-doh", "nondoh", "non_doh", "non doh", "non-doh-browsing", "nondoh-browsing"],
    "doh": ["doh", "doh-browsing", "doh-tunnel", "benign-doh", "benigndoh", "benign_doh", "benign doh",
            "malicious-doh", "maliciousdoh", "malicious_doh", "malicious doh", "benign", "malicious",
            "chrome", "firefox", "dns2tcp", "dnscat2", "iodine"],
}

# Accepted label names of task l2 (is the DoH flow a tunnel).
L2_NAMES = {
    "benign_doh": ["benign", "benign-doh", "benigndoh", "benign_doh", "benign doh", "browsing", "chrome",
                   "firefox", "doh-browsing"],
    "malicious_doh": ["malicious", "malicious-doh", "maliciousdoh", "malicious_doh", "malicious doh",
                      "tunneling", "tunnel", "doh-tunnel", "dns2tcp", "dnscat2", "iodine"],
}

# Words that make a column a label candidate.
LABEL_WORDS = ["label", "class", "target", "scenario", "category", "tunnel", "traffic", "doh", "activity",
               "type"]

# Names of the feature groups.
FEATURE_GROUPS = ["flow_volume", "packet_length", "packet_timing", "response_timing"]


def label_names(task: str) -> dict[str, list[str]]:
    if task not in ("l1", "l2"):
        raise ValueError(f"unknown task {task!r}; expected 'l1' or 'l2'")
    return L1_NAMES if task == "l1" else L2_NAMES


def clean_label(label: Column) -> Column:
    return F.lower(F.trim(label.cast("string")))


def label_number(label: Column, task: str) -> Column:
    """0/1 for an accepted label name, null for any other."""
    number = F.lit(None).cast("int")
    for value, names in enumerate(label_names(task).values()):
        number = F.when(clean_label(label).isin(names), F.lit(value)).otherwise(number)
    return number


def is_identifier(column: str) -> bool:
    plain = re.sub("[-_]", " ", column.lower()).strip()
    return plain in IDENTIFIER_COLUMNS or column.lower() in IDENTIFIER_COLUMNS


def feature_columns(columns: list[str], label: str) -> list[str]:
    """Columns that may become features: not the label, not internal (``__``), not an identifier."""
    return [c for c in columns if c != label and not c.startswith("__") and not is_identifier(c)]


def find_label(columns: list[str], wanted: str | None = None) -> str:
    """The label column: the wanted one, else the only ``label``/``class``, else one near match."""
    if wanted is not None:
        named = [c for c in columns if c.lower() == wanted.strip().lower()]
        if not named:
            raise ValueError(f"label column {wanted!r} not found in {columns}")
        return named[-1]
    exact = [c for c in columns if c.strip().lower() in ("label", "class")]
    near = [c for c in columns if any(word in c.lower() for word in ("label", "class", "target"))]
    for found in (exact, near):
        if len(found) == 1:
            return found[0]
    raise ValueError(f"label column is not clear: {near or columns}; name it")


def label_candidates(columns: list[str]) -> list[str]:
    return [c for c in columns if any(word in c.lower() for word in LABEL_WORDS)]


def feature_group(name: Column) -> Column:
    """volume / length / timing / response group of a feature name, null for other names."""
    plain = F.lower(F.regexp_replace(name, r"[\s_]+", ""))
    volume = (plain == "duration") | plain.startswith("flowbytes") | plain.rlike("^flow.*rate$")
    return (F.when(volume, F.lit("flow_volume"))
            .when(plain.startswith("packetlength"), F.lit("packet_length"))
            .when(plain.startswith("packettime"), F.lit("packet_timing"))
            .when(plain.startswith("responsetime"), F.lit("response_timing")))
