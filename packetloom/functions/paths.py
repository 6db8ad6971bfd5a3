"""Capture metadata read off a root-relative path."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in a path and what they stand for.  Rules are tried from the top.
MALICIOUS_WORDS = ["malicious", "iodine", "dns2tcp", "dnscat2"]
NON_DOH_WORDS = ["nondoh", "non_doh", "non-doh", "non doh"]
TOOLS = ["iodine", "dns2tcp", "dnscat2"]
BENIGN_CLIENTS = ["firefox", "chrome", "google", "cloudflare", "adguard", "quad9"]
NON_DOH_APPS = ["firefox", "chrome", "video", "download"]
CAPTURE_SUFFIXES = [".pcap", ".pcapng", ".cap"]


def _has(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def _first_of(text: Column, words: list[str], default: str) -> Column:
    found = F.lit(default)
    for word in reversed(words):
        found = F.when(text.contains(word), F.lit(word)).otherwise(found)
    return found


def _outcome(category: str, detail: Column) -> Column:
    return F.struct(F.lit(category).alias("category"),
                    F.concat(F.lit(category + "_"), detail).alias("scenario_id"),
                    F.lit(category == "malicious_doh").alias("is_malicious"))


def _slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def path_metadata(path: Column) -> Column:
    """Struct of category, scenario_id and is_malicious.

    Order: malicious, benign, non-DoH, plain DoH, other.
    """
    text = F.lower(_slashes(path))
    benign = _outcome("benign_doh", _first_of(text, BENIGN_CLIENTS, "browsing"))
    # "ndoh" counts as non-DoH unless it is the tail of "benigndoh".
    non_doh = _has(text, NON_DOH_WORDS) | text.rlike("(?<!benig)ndoh")
    return (F.when(_has(text, MALICIOUS_WORDS), _outcome("malicious_doh", _first_of(text, TOOLS, "tunnel")))
            .when(text.contains("benign"), benign)
            .when(non_doh, _outcome("non_doh", _first_of(text, NON_DOH_APPS, "browsing")))
            .when(text.contains("doh"), benign)
            .otherwise(_outcome("non_doh", F.lit("unknown"))))


def runner_path_metadata(path: Column) -> Column:
    """The second rule set: non-DoH words win over benign ones, with shorter lists."""
    text = F.lower(path)
    tool = _first_of(text, ["dns2tcp", "dnscat2"], "iodine")
    return (F.when(_has(text, MALICIOUS_WORDS), _outcome("malicious_doh", tool))
            .when(_has(text, NON_DOH_WORDS + ["ndoh"]),
                  _outcome("non_doh", _first_of(text, NON_DOH_APPS, "browsing")))
            .when(_has(text, ["benign", "doh"]),
                  _outcome("benign_doh", _first_of(text, ["firefox", "chrome"], "general")))
            .otherwise(_outcome("non_doh", F.lit("browsing"))))


def _stem(name: Column) -> Column:
    """Name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def session_id(path: Column) -> Column:
    """Cleaned file stem; a stem under six characters gets its folder's name in front."""
    slashed = _slashes(path)
    stem = _stem(F.regexp_extract(slashed, r"([^/]*)$", 1))
    capture_tail = F.lit(False)
    for suffix in CAPTURE_SUFFIXES:
        capture_tail = capture_tail | stem.endswith(suffix)
    stem = F.when(capture_tail, _stem(stem)).otherwise(stem)
    clean = F.regexp_replace(stem, r"[^a-zA-Z0-9_\-]", "_")
    parent = F.regexp_extract(slashed, r"([^/]+)/+[^/]*$", 1)
    prefixed = F.concat_ws("_", F.regexp_replace(parent, r"[^a-zA-Z0-9_\-]", "_"), clean)
    return F.when((F.length(clean) < 6) & ~parent.isin("", "."), prefixed).otherwise(clean)


def source_id(path: Column, root: str, member: Column | None = None, nested: Column | None = None) -> Column:
    """Path relative to the root, then archive member names: ``dir/a.zip:member/nested``."""
    scheme_free = F.regexp_replace(path, r"^file:/*", "/")
    base = "/" + root.removeprefix("file:").strip("/")
    inside = F.substring(scheme_free, len(base) + 2, 1 << 30)
    relative = F.when(scheme_free.startswith(base + "/"), inside).otherwise(
        F.regexp_extract(scheme_free, r"([^/]*)$", 1))
    if member is None:
        return relative
    inner = F.regexp_replace(_slashes(member), r"^/+|/+$", "")
    if nested is not None:
        inner = F.concat_ws("/", inner, F.regexp_replace(_slashes(nested), r"^/+|/+$", ""))
    return F.when(member.isNull(), relative).otherwise(F.concat(relative, F.lit(":"), inner))
