"""Ordered computations over groups of any size.

A window function keeps one whole group in one task.  That is the right plan for ordinary groups and
the wrong one for a group that holds a large share of the table, so the helpers here offer both:

``by_heat``      plain windows for ordinary groups, a second form for the few busy ones.
``running``      running aggregates over (group, bucket) pieces plus one carry row per piece.
``first_n``      the first n rows of each group, pruned on hashed pieces first.
``hash_cut``     an exact pseudo-random sample of k rows per class, without shuffling the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.session import ensure_checkpoint_dir

# A group above this many rows leaves the one-task path.  There is at most one such group per
# ROWS_PER_PIECE input rows, so the list of busy groups stays short.
ROWS_PER_PIECE = 4_000_000

# A list of busy groups up to this long is broadcast; a longer one is joined like any other table.
MAX_LISTED = 50_000

Rows = Callable[[DataFrame], DataFrame]


def busy_groups(df: DataFrame, keys: Sequence[str], rows_per_piece: int) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > rows_per_piece).select(*keys)


def by_heat(df: DataFrame, keys: Sequence[str], ordinary: Rows, busy: Rows,
            rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Apply ``ordinary`` to groups of at most ``rows_per_piece`` rows and ``busy`` to the others.

    One count per group (combined before its shuffle) lists the busy groups when the plan is built.
    Usually there are none and the plan is ``ordinary`` alone.  Rows with a null key are ordinary.
    """
    keys = list(keys)
    hot = busy_groups(df, keys, rows_per_piece)
    listed = hot.limit(MAX_LISTED + 1).collect()
    if not listed:
        return ordinary(df)
    if len(listed) <= MAX_LISTED:
        hot = F.broadcast(df.sparkSession.createDataFrame(listed, hot.schema))
    return ordinary(df.join(hot, keys, "left_anti")).unionByName(busy(df.join(hot, keys, "left_semi")))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Used between the steps of a busy path: each step reads its input more than once, and a written
    table survives the loss of executors.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/packetloom/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _fold(kind: str, value: Column, order: Sequence[str] | None = None) -> Column:
    if kind == "sum":
        return F.sum(value)
    if kind == "max":
        return F.max(value)
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    raise ValueError(f"unknown running aggregate: {kind}")


def running(df: DataFrame, by: Sequence[str], bucket: str, order: Sequence[str],
            specs: dict[str, tuple[str, Column, bool]]) -> DataFrame:
    """Running aggregates of each ``by`` group in (``bucket``, ``order``) order.

    ``bucket`` must not decrease along the order.  ``specs`` maps a new column to (kind, value,
    inclusive); kind is sum, max or last (last non-null).  Rows are sorted only inside a
    (group, bucket) piece; one carry row per piece brings in everything before it.  A sum also gets
    ``<name>_total`` for its whole group.  Group keys must not be null.
    """
    by, order = list(by), list(order)
    piece = by + [bucket]
    totals = df.groupBy(*piece).agg(
        *[_fold(kind, value, order).alias(f"_t_{name}") for name, (kind, value, _) in specs.items()])
    # by may be empty: the carry table then has one row per bucket of the whole input.
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = list(piece)
    for name, (kind, _, _) in specs.items():
        past = F.col(f"_t_{name}")
        if kind == "sum":
            carried.append(F.coalesce(F.sum(past).over(before), F.lit(0)).alias(f"_c_{name}"))
            carried.append(F.sum(past).over(group).alias(f"{name}_total"))
        elif kind == "max":
            carried.append(F.max(past).over(before).alias(f"_c_{name}"))
        else:
            carried.append(F.last(past, ignorenulls=True).over(before).alias(f"_c_{name}"))
    out = df.join(totals.select(*carried), piece)
    local = Window.partitionBy(*piece).orderBy(*order)
    columns = {}
    for name, (kind, value, inclusive) in specs.items():
        frame = local.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        carry = F.col(f"_c_{name}")
        if kind == "sum":
            columns[name] = carry + F.coalesce(F.sum(value).over(frame), F.lit(0))
        elif kind == "max":
            columns[name] = F.greatest(carry, F.max(value).over(frame))
        else:
            columns[name] = F.coalesce(F.last(value, ignorenulls=True).over(frame), carry)
    return out.withColumns(columns).drop(*[f"_c_{name}" for name in specs])


def first_n(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int | Column,
            few_groups: bool = False, rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """The first ``n`` rows of every group.

    Ordinary groups are ranked in one task.  Busy ones, and all groups with ``few_groups`` (classes, say),
    are ranked in ever fewer hashed pieces, each of which passes on at most ``n`` rows, so no task sees a
    whole group.  ``n`` may be a column that is constant per group.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    limit = n if isinstance(n, Column) else F.lit(n)

    def keep(rows: DataFrame, *extra: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by, *extra).orderBy(*keys))
        return rows.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")

    def in_pieces(rows: DataFrame) -> DataFrame:
        for pieces in (4096, 64):
            rows = keep(rows.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(pieces))), "_salt")
        return keep(rows.drop("_salt"))

    if few_groups:
        return in_pieces(df)
    return by_heat(df, by, keep, in_pieces, rows_per_piece)


def one_row(df: DataFrame) -> Column:
    """A one-row table as a struct value, for use in expressions of another table."""
    return df.select(F.struct("*")).scalar()


def seeded_hash(seed: int, *columns: Column | str) -> Column:
    """A 32-digit hex hash other engines can repeat: md5 of ``seed|col|col``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


# Hash prefixes of 4 hex digits: 65,536 pieces per class.
_PREFIX = 4
# Classes are label values; a stratified draw over more of them than this is refused.
MAX_CLASSES = 10_000


def class_counts(df: DataFrame, label: str) -> dict:
    """Row count per label value, read to the driver after a check that there are few of them."""
    rows = df.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"column {label!r} has over {MAX_CLASSES} values; it is not a class label")
    return {row[label]: row["count"] for row in rows}


def hash_cut(df: DataFrame, label: str, ident: str, seed: int, take: dict, flag: str,
             decide_on: DataFrame | None = None) -> DataFrame:
    """Mark ``take[class]`` rows of each class, the lowest by (seeded hash, ident), in column ``flag``.

    Three passes, none of which shuffles rows: counts per (class, hash prefix) find the prefix where
    the cut falls, the rows of that prefix give the exact cut value, and the last pass compares.
    ``ident`` must be unique.  Classes are bounded by MAX_CLASSES, so the cuts are broadcast.  ``decide_on`` is a
    narrow table of the same (label, ident) rows for the first two passes, so that ``df`` is read once.
    """
    spark = df.sparkSession
    field = df.schema[label]
    wanted = spark.createDataFrame(
        [(name, int(k)) for name, k in take.items()],
        f"`{label}` {field.dataType.simpleString()}, _take long")
    hashed = seeded_hash(seed, F.col(ident).cast("string"))
    keyed = (df if decide_on is None else decide_on).select(label, F.col(ident).cast("string").alias("_id"), hashed.alias("_h"),
                      F.substring(hashed, 1, _PREFIX).alias("_p"))
    counts = keyed.groupBy(label, "_p").agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.partitionBy(label).orderBy("_p")
    counts = counts.withColumn("_end", F.sum("_n").over(ordered))
    edge = (counts.join(F.broadcast(wanted), label)
            .filter((F.col("_take") > F.col("_end") - F.col("_n")) & (F.col("_take") <= F.col("_end")))
            .select(label, "_p", (F.col("_take") - F.col("_end") + F.col("_n")).alias("_k")))
    in_edge = keyed.join(F.broadcast(edge), [label, "_p"])
    spot = Window.partitionBy(label).orderBy("_h", "_id")
    cuts = (in_edge.withColumn("_r", F.row_number().over(spot)).filter(F.col("_r") == F.col("_k"))
            .select(label, F.col("_h").alias("_ch"), F.col("_id").alias("_ci")))
    out = df.join(F.broadcast(cuts), label, "left")
    own = F.struct(hashed.alias("h"), F.col(ident).cast("string").alias("i"))
    cut = F.struct(F.col("_ch").alias("h"), F.col("_ci").alias("i"))
    return (out.withColumn(flag, F.coalesce(F.col("_ch").isNotNull() & (own <= cut), F.lit(False)))
            .drop("_ch", "_ci").select(*df.columns, flag))


def log_bucket(value: Column, steps: int = 64) -> Column:
    """A bucket number that never decreases with ``value`` and resolves every magnitude alike."""
    v = value.cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v) * 1e6) * steps).cast("long")


def score_bucket(score: Column, steps: int = 64) -> Column:
    """``log_bucket`` for scores: fine near 0, near 1 and for margins outside that range."""
    s = score.cast("double")

    def level(x: Column) -> Column:
        return F.signum(x) * F.log1p(F.abs(x) * 1e6)

    return F.floor((level(s) - level(1.0 - s)) * steps).cast("long")
