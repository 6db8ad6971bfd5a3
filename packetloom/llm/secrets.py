"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by the sha-256 of its content.  The ledger is a table with one row per blob
and scan: the rule versions applied and the spans found.  A scan reads only blobs for which a wanted rule version is
missing, once each however many paths hold them, and findings are joined back to all paths.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.tables import text_or_empty
from packetloom.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its matches count if ``group`` of the pattern has at least ``least`` characters.

    A text is only searched if it contains one of the ``hints`` (compared in lower case), if there are any.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", 1, r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6,
         ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
# Formats that carry their own mark.
MARKED = (
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1, ("private key-----",)),
    Rule("web_token", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, ("eyj",)),
    Rule("hosting_token", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, ("xox",)),
)
RULES = BASE + MARKED
SPANS = "array<struct<rule:string,start:int,end:int>>"
LEDGER = f"blob string, rules array<string>, spans {SPANS}"


def find(text: str, lowered: str, rule: Rule) -> Iterator[tuple[int, int]]:
    """Spans of a rule in code points: leftmost matches that do not overlap, short ones dropped."""
    if rule.hints and not any(h in lowered for h in rule.hints):
        return
    for match in re.finditer(rule.pattern, text, re.ASCII):
        if match.end(rule.group) - match.start(rule.group) >= rule.least:
            yield match.span()


def addresses(versions: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns of every version with the address of its content; a null text is empty."""
    return versions.select(*keep, F.sha2(text_or_empty(), 256).alias("blob"))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger so far; empty if nothing was scanned yet."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, folder: str, rules: Sequence[Rule] = RULES) -> None:
    """Add to the ledger what is missing: each unseen (blob, rule version) of the texts in ``versions``."""
    spark = versions.sparkSession
    done = (read_ledger(spark, folder).select("blob", F.explode("rules").alias("rule")).groupBy("blob")
            .agg(F.collect_set("rule").alias("done")))
    wanted = F.array(*[F.lit(r.name) for r in rules])
    # Copies inside one input split collapse before the shuffle, so a text of very many paths stays small.
    blobs = (versions.select(F.sha2(text_or_empty(), 256).alias("blob"), text_or_empty().alias("_text"))
             .groupBy("blob").agg(F.first("_text").alias("_text")))
    unseen = (blobs.join(done, "blob", "left")
              .withColumn("missing", F.when(F.col("done").isNull(), wanted)
                          .otherwise(F.array_except(wanted, F.col("done"))))
              .filter(F.size("missing") > 0).select("blob", "_text", "missing"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_name = {r.name: r for r in rules}
        for batch in batches:
            blob, texts, missing = (c.to_pylist() for c in batch.columns)
            spans = []
            for text, names in zip(texts, missing):
                lowered = text.lower()
                spans.append([{"rule": n, "start": a, "end": b}
                              for n in names for a, b in find(text, lowered, by_name[n])])
            kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(blob, pa.string()), pa.array(missing, pa.list_(pa.string())), pa.array(spans, kind)],
                names=["blob", "rules", "spans"])
    unseen.mapInArrow(run, LEDGER).write.mode("append").parquet(folder)


def findings(versions: DataFrame, folder: str, rules: Sequence[Rule] = RULES,
             keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every version with blob and spans (array of rule, kind, start, end by start).

    Only spans of the given rule versions count, in order of start, then of the rules; repeats in the ledger (a scan
    that was run twice) count once.  A null or empty text has none.  Repeated rows each get the spans of their text.
    Other columns are ignored; an empty table gives no rows.
    """
    order = spark_rules(rules)
    held = (read_ledger(versions.sparkSession, folder).select("blob", F.explode("spans").alias("s"))
            .select("blob", "s.*").filter(F.col("rule").isin([r.name for r in rules])).distinct())
    held = (held.withColumn("place", F.element_at(order, F.col("rule")))
            .groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "place", "end", "rule"))).alias("spans")))
    return (addresses(versions, keep).join(held, "blob", "left")
            .withColumn("spans", F.coalesce("spans", F.array().cast(
                "array<struct<start:int,place:int,end:int,rule:string>>"))))


def spark_rules(rules: Sequence[Rule]):
    """Rule name to its place in the list, as a map column."""
    return F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])


def new_ledger(spark: SparkSession) -> str:
    """A folder for a ledger that starts empty, in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/packetloom/ledger-{uuid.uuid4().hex}"


