"""What the corpus operators share: column rules for texts, and ordered sums that never meet in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.operators.ordered import materialize

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

# Bytes of rows that a task hands to its Python worker at a time.
ARROW_BYTES = 8 << 20
_ARROW_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session hands rows to Python workers ARROW_BYTES at a time from now on, unless it has a bound of its own.

    Spark's bound is 64 MB, of which a task holds several copies: two while its buffers grow, and the worker's.
    """
    if df.sparkSession.conf.get(_ARROW_BOUND, None) is None:
        df.sparkSession.conf.set(_ARROW_BOUND, str(ARROW_BYTES))
    return df


def hot_keys(df: DataFrame, key: str, rows_per_piece: int) -> DataFrame:
    """(key, pieces) of the keys above ``rows_per_piece`` rows, as a written table.

    Counts are combined before their shuffle.  The table has at most rows / rows_per_piece rows; written, its
    size is known when the plan that joins it is made, so Spark broadcasts it only while it is small.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_piece)
    return materialize(counts.select(key, F.ceil(F.col("_n") / rows_per_piece).alias("pieces")))


def prefix_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Running sums (row included) of columns within ``by`` in ``order``; ``sums`` maps new column to column.

    Rows are dealt out by sampled ranges of (by, order), so a group of any size is spread over tasks; each range
    adds what the ranges before it hold, from one carry row per (group, range).
    """
    by = list(by)
    ranged = materialize(df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in by], *order)
                         .withColumn("_range", F.spark_partition_id()))
    keys = [F.coalesce(F.xxhash64(*by), F.lit(0)).alias("_by") if by else F.lit(0).alias("_by"), "_range"]
    parts = ranged.groupBy(*keys).agg(*[F.sum(v).alias(f"_in_{k}") for k, v in sums.items()])
    before = Window.partitionBy("_by").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select("_by", "_range", *[
        F.coalesce(F.sum(f"_in_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in sums])
    within = Window.partitionBy("_by", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.select("*", keys[0]).join(carry, ["_by", "_range"])
            .withColumns({k: F.sum(v).over(within) + F.col(f"_before_{k}") for k, v in sums.items()})
            .drop("_by", "_range", *[f"_before_{k}" for k in sums]))


def one_of_each(rows: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows`` (some of ``source``) with one row for each ``key``; rows are only dealt out again if any key repeats."""
    repeated = source.select(*key).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return rows if repeated.isEmpty() else rows.dropDuplicates(list(key))


def bit_is_set(bits: Column, place: Column) -> Column:
    """Whether a bitmap of Spark's bitmap functions has the bit at ``place``."""
    place = place.cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), place % 8 + 1)) > 0


def with_membership(rows: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
    """``rows`` with the boolean ``name``: whether the integer ``key`` (false for null) is among the one column of ``ids``.

    Where ids lie close, they are packed into bitmaps of 32,768 ids each, so that the list is some bits an id and
    mostly small enough for Spark to broadcast; where they are scattered, bitmaps would be larger than the list and
    the list itself is joined.
    """
    ids = ids.select(F.col(ids.columns[0]).cast("long").alias("_id")).filter("_id IS NOT NULL")
    bits = materialize(ids.groupBy(F.bitmap_bucket_number("_id").alias("_bucket"))
                       .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("_bits"),
                            F.count(F.lit(1)).alias("_n")))
    held = bits.agg(F.count(F.lit(1)).alias("buckets"), F.sum("_n").alias("ids")).first()
    if (held.ids or 0) < 256 * held.buckets:
        listed = ids.distinct().withColumn(name, F.lit(True))
        return rows.join(listed, rows[key] == listed["_id"], "left").drop("_id").withColumn(
            name, F.coalesce(name, F.lit(False)))
    place = F.bitmap_bit_position(F.col(key))
    return (rows.join(bits.drop("_n"), F.bitmap_bucket_number(F.col(key)) == F.col("_bucket"), "left")
            .withColumn(name, F.coalesce(bit_is_set(F.col("_bits"), place), F.lit(False))).drop("_bucket", "_bits"))
