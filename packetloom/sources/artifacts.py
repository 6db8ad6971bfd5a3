"""Run-metric, evidence and delay JSON in; tables and manifests out."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.ordered import one_row

RATES = "precision double, recall double, f1_score double, f1 double, fpr double, roc_auc double, pr_auc double, accuracy double"
RUN_FIELDS = f"task string, model string, split_protocol string, window_size int, tn long, fp long, fn long, tp long, {RATES}"
RUNS_SCHEMA = (f"manifest_version string, task string, "
               f"runs array<struct<{RUN_FIELDS.replace(' ', ':').replace(',:', ',')}>>")
EVIDENCE_FIELDS = ["default_macro_f1", "f1_macro", "default_positive_f1", "f1_positive_class", "accuracy", "roc_auc",
                   "pr_auc", "default_fpr", "false_positive_rate", "precision_macro", "precision_positive_class",
                   "recall_macro", "recall_positive_class", "inference_latency_per_sample_ms", "calibrated_macro_f1",
                   "calibrated_test_fpr", "selected_threshold"]
EVIDENCE_SCHEMA = ("manifest_version string, task string, models map<string, struct<"
                   + ",".join(f"{f}:double" for f in EVIDENCE_FIELDS) + ">>")
STATS = ["mean", "median", "p50", "p95", "p99", "min", "max", "std"]
SUMMARY = ("struct<count:long," + ",".join(f"{s}_{u}:double" for u in ("seconds", "ms") for s in STATS)
           + ",throughput_samples_per_second:double>")
DELAY_PARTS = ["traffic_collection_delay", "preprocessing_latency", "inference_latency", "end_to_end_latency"]
DELAY_SCHEMA = ("manifest_version string, generated_at_utc string, claim_boundary string, total_benchmarks int, "
                "benchmarks array<struct<claim_boundary:string,task:string,model:string,window_size:int,"
                "split_protocol:string,sample_count:int,batch_size:int,device:string,device_name:string,"
                "warmup_iterations:int," + ",".join(f"{p}:{SUMMARY}" for p in DELAY_PARTS) + ">>")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per run of a metrics file, in file order as ``run_no``; a run's own task goes first."""
    rows = _json(spark, path, RUNS_SCHEMA).select(
        "manifest_version", F.col("task").alias("_task"), F.posexplode("runs").alias("run_no", "_r"))
    out = rows.select("manifest_version", F.col("run_no").cast("long"), "_task", "_r.*")
    return out.withColumn("task", F.coalesce("task", "_task")).drop("_task")


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """One row per model of an evidence file."""
    rows = _json(spark, path, EVIDENCE_SCHEMA).select("manifest_version", "task", F.explode("models").alias("model", "_m"))
    return rows.select("manifest_version", "task", "model", "_m.*")


def read_delays(spark: SparkSession, path: str) -> DataFrame:
    """One row per benchmark of a delay file, with the file's own fields on each."""
    rows = _json(spark, path, DELAY_SCHEMA).select(
        "manifest_version", "generated_at_utc", "total_benchmarks", F.posexplode("benchmarks").alias("benchmark_no", "_b"))
    return rows.select("manifest_version", "generated_at_utc", "total_benchmarks", "benchmark_no", "_b.*")


def experiment_manifest(counters: DataFrame, classes: DataFrame, settings: dict, version: str = "1.0.0") -> DataFrame:
    """One row that describes a run: its settings (caps, seed, lengths), ingest counters and class counts.

    ``counters`` has one row (``ingest_counters``); ``classes`` a few (``split_manifest``).
    """
    pairs = [F.lit(str(x)) for item in sorted(settings.items()) for x in item]
    listed = classes.agg(F.sort_array(F.collect_list(F.struct(*sorted(classes.columns)))).alias("c"))
    return counters.select(
        F.lit(version).alias("manifest_version"),
        (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).alias("settings"),
        F.struct("*").alias("counters")).withColumn("classes", one_row(listed)["c"])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", force: bool = False) -> None:
    """Write CSV (with header), JSON or Parquet; an existing target is an error unless forced."""
    writer = df.write.mode("overwrite" if force else "errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet", force: bool = False) -> None:
    """Write several tables under one folder; nothing is written if any of them exists, unless forced."""
    if not force:
        spark = next(iter(tables.values())).sparkSession
        for name in tables:
            if _exists(spark, f"{folder}/{name}"):
                raise FileExistsError(f"{folder}/{name} exists; pass force=True to replace it")
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", fmt, force)


def publish(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet", force: bool = False) -> str:
    """Publish a set of tables as a whole; returns its version.

    Tables go to a folder of their own, and a manifest that names them is written last, as one file that Spark puts in
    place by a rename.  Readers follow the newest manifest (``read_published``), so they see the old set until all of
    the new one is there, and keep seeing it if a write fails.  A set that was published before is an error unless
    forced; sets that newer ones have replaced stay readable by their version.
    """
    spark = next(iter(tables.values())).sparkSession
    past = manifests(spark, folder)
    number = 0 if past is None else past.agg(F.max("number")).first()[0] + 1
    if number and not force:
        raise FileExistsError(f"{folder} has a published set; pass force=True to replace it")
    version = uuid.uuid4().hex
    for name, df in tables.items():
        write_table(df, f"{folder}/sets/{version}/{name}", fmt)
    row = spark.createDataFrame([(number, version, fmt, sorted(tables))], MANIFEST)
    row.coalesce(1).write.mode("append").json(f"{folder}/manifests")
    return version


MANIFEST = "number long, version string, format string, tables array<string>"


def manifests(spark: SparkSession, folder: str) -> DataFrame | None:
    """The manifests of all sets published under ``folder``; None before the first."""
    path = f"{folder}/manifests"
    return spark.read.schema(MANIFEST).json(path) if _exists(spark, path) else None


def read_published(spark: SparkSession, folder: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of the newest set, or of ``version``; of two sets published at once the one of higher version."""
    past = manifests(spark, folder)
    found = None if past is None else past.filter(F.lit(version is None) | (F.col("version") == F.lit(version))).orderBy(
        F.desc("number"), F.desc("version")).first()
    if found is None:
        raise FileNotFoundError(f"no published set in {folder}")
    reader = spark.read.option("header", True).format(found.format)
    return {name: reader.load(f"{folder}/sets/{found.version}/{name}") for name in found.tables}


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's readers find anything at the path."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return False
        raise
    return True
