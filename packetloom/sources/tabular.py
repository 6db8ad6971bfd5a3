"""Flow-statistics tables and the inventory of their files."""

from __future__ import annotations

import csv
import hashlib
import io
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from packetloom.functions.names import label_candidates
from packetloom.operators.ordered import materialize
from packetloom.operators.tabular import trim_names

# Files up to this size are read as one value; larger ones in ranges, of which a task holds some lines.
VALUE_BYTES = 16 << 20

# A longer footer of a large Parquet file is left to Spark's reader.
FOOTER_BYTES = 16 << 20
HASHES = "path string, sha256 string"
DESCRIBED = "uri string, columns array<string>, names array<string>, rows long"
SUFFIXES = {".csv": "csv", ".parquet": "parquet"}


def read_table(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A CSV (with header) or Parquet table with trimmed column names, by suffix."""
    if path.lower().rstrip("/").endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
    elif path.lower().rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported table format: {path}")
    df = trim_names(df)
    return df if rows is None else df.limit(rows)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def list_files(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    """Path and size of the files under ``root`` with one of the suffixes; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.lower(file_name(F.col("path")))
    hit = reduce(lambda a, b: a | b, [name.endswith(s) for s in suffixes])
    return files.filter(hit).select("path", F.col("_metadata.file_path").alias("uri"), F.col("length").alias("size_bytes"))


def content_hashes(spark: SparkSession, paths: list[str], value_bytes: int = VALUE_BYTES) -> DataFrame:
    """(path, sha256) of files of any size.

    A file of up to ``value_bytes`` is hashed as one value.  A larger one is read in ranges, whose lines one task takes
    in the order of the file, some at a time; whether the last line ends in a line feed shows in the size.
    """
    if not paths:
        return spark.createDataFrame([], HASHES)
    files = spark.read.format("binaryFile").load(paths)
    small = files.filter(F.col("length") <= value_bytes).select("path", F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > value_bytes).select("path", F.col("_metadata.file_path").alias("uri"))
    listed = [r.path for r in large.select("path").collect()]
    if not listed:
        return small
    return small.unionByName(_in_order(spark, listed).join(large, "uri").select("path", "sha256"))


def _in_order(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(uri, sha256, footer) of files read in ranges.

    ``footer`` ends a Parquet file, from its metadata on: empty for other files, null above FOOTER_BYTES.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"),
        F.col("value").cast("binary").alias("line"))
    return (lines.repartition("uri").sortWithinPartitions("uri", "start", "nth")
            .mapInArrow(_hash_lines, "uri string, sha256 string, footer binary"))


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uri = digest = None
    fed = size = 0
    tail = bytearray()

    def feed(data):
        nonlocal fed
        digest.update(data)
        fed += len(data)
        tail.extend(data)
        if len(tail) > 2 * FOOTER_BYTES:
            del tail[:-FOOTER_BYTES]

    def done():
        if fed > size:
            raise ValueError(f"{uri} has grown while it was read")
        feed(b"\n" * (size - fed))
        return pa.RecordBatch.from_pydict({
            "uri": [uri], "sha256": [digest.hexdigest()], "footer": pa.array([_footer(bytes(tail[-FOOTER_BYTES:]))], pa.binary())})
    for batch in batches:
        uris, sizes, lines = batch.column(0).to_pylist(), batch.column(1), batch.column(4).to_pylist()
        cuts = [0, *[i for i in range(1, len(uris)) if uris[i] != uris[i - 1]], len(uris)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            data = b"\n".join(lines[a:b])
            if uris[a] != uri:
                if uri is not None:
                    yield done()
                uri, digest, fed, size = uris[a], hashlib.sha256(), 0, sizes[a].as_py()
                tail.clear()
            else:
                data = b"\n" + data
            feed(data)
    if uri is not None:
        yield done()


def _footer(tail: bytes) -> bytes | None:
    if tail[-4:] != b"PAR1" or len(tail) < 8:
        return b""
    length = int.from_bytes(tail[-8:-4], "little") + 8
    return tail[-length:] if length <= len(tail) else None


def file_inventory(spark: SparkSession, root: str, value_bytes: int = VALUE_BYTES) -> DataFrame:
    """One row per table file: format, size, SHA-256, rows, columns with types, label candidates.

    Parquet footers are read in tasks, those of files above ``value_bytes`` by the pass that hashes them; rows of all
    CSV files are counted by one read, their headers by another.  A file that is no table has null rows.  An empty
    folder gives no rows.
    """
    listed = list_files(spark, root, list(SUFFIXES)).withColumn("format", F.when(
        F.lower("path").endswith(".csv"), "csv").otherwise("parquet"))
    files = listed.select("path", "format", "size_bytes").collect()
    paths = {kind: [r.path for r in files if r.format == kind] for kind in ("csv", "parquet")}
    hashed = content_hashes(spark, [r.path for r in files if r.size_bytes <= value_bytes], value_bytes)
    described = spark.createDataFrame([], DESCRIBED)
    if paths["csv"]:
        lines = spark.read.option("lineSep", "\n").text(paths["csv"]).filter(F.col("_metadata.file_block_start") == 0).select(
            F.col("_metadata.file_path").alias("uri"), "value", F.monotonically_increasing_id().alias("nth"))
        heads = lines.groupBy("uri").agg(F.min_by("value", "nth").alias("head")).mapInPandas(
            _describe_heads, "uri string, columns array<string>, names array<string>")
        rows = (spark.read.option("header", True).schema("first string").csv(paths["csv"])
                .groupBy(F.col("_metadata.file_path").alias("uri")).agg(F.count(F.lit(1)).alias("rows")))
        described = described.unionByName(heads.join(rows, "uri", "left").withColumn(
            "rows", F.coalesce("rows", F.lit(0).cast("long"))))
    if paths["parquet"]:
        whole = spark.read.format("binaryFile").load(paths["parquet"]).filter(F.col("length") <= value_bytes)
        described = described.unionByName(whole.select(F.col("_metadata.file_path").alias("uri"), "content").mapInPandas(
            _describe_footers, DESCRIBED))
    large = [r.path for r in files if r.size_bytes > value_bytes]
    if large:
        found = materialize(_in_order(spark, large).join(listed.select("path", "uri", "format"), "uri"))
        hashed = hashed.unionByName(found.select("path", "sha256"))
        tables = found.filter("format = 'parquet'")
        described = described.unionByName(tables.filter("footer IS NOT NULL").select("uri", F.col("footer").alias("content"))
                                          .mapInPandas(_describe_footers, DESCRIBED))
        for r in tables.filter("footer IS NULL").select("path", "uri").collect():  # footers above FOOTER_BYTES
            df = spark.read.parquet(r.path)
            names = [n.strip() for n in df.columns]
            described = described.unionByName(df.select(F.count(F.lit(1)).alias("rows")).select(
                F.lit(r.uri).alias("uri"), F.array(*[F.lit(f"{n}: {t}") for n, (_, t) in zip(names, df.dtypes)]).alias("columns"),
                F.array(*[F.lit(n) for n in names]).alias("names"), "rows"))
    candidates = F.udf(lambda names: None if names is None else label_candidates(names), "array<string>")  # one call per file
    return (listed.join(hashed, "path").join(described, "uri", "left")
            .select(file_name(F.col("path")).alias("name"), "format", "size_bytes", "sha256", "rows", "columns",
                    candidates("names").alias("label_candidates")).orderBy("name"))


def _describe_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        names = [[n.strip() for n in next(csv.reader([head.rstrip("\r").removeprefix("\ufeff")]), [])] for head in batch["head"]]
        yield pd.DataFrame({"uri": batch["uri"], "columns": [[f"{n}: string" for n in own] for own in names],
                            "names": names})


def _describe_footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for uri, content in zip(batch["uri"], batch["content"]):
            try:
                file = pq.ParquetFile(io.BytesIO(content))
            except pa.ArrowInvalid:
                continue
            fields = from_arrow_schema(file.schema_arrow, prefer_timestamp_ntz=True).fields
            names = [f.name.strip() for f in fields]
            yield pd.DataFrame({"uri": [uri], "columns": [[f"{n}: {f.dataType.simpleString()}" for n, f in zip(names, fields)]],
                                "names": [names], "rows": [file.metadata.num_rows]})
