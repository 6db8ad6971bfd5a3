"""Exact quantiles and delay statistics for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.ordered import ROWS_PER_PIECE, by_heat, log_bucket, running


def _interpolate(lower: Column, upper: Column, share: Column) -> Column:
    return lower * (1.0 - share) + upper * share


def quantiles(df: DataFrame, value: str, by: list[str], shares: list[float],
              rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Exact quantiles ``q0, q1, ...`` per group, interpolated at position (n - 1) * share.

    A busy group is first collapsed to (value, count), then ranked in value buckets; only rows at the
    wanted positions are kept.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    names = [f"q{i}" for i in range(len(shares))]

    def ordinary(part: DataFrame) -> DataFrame:
        found = F.percentile("_v", F.array(*[F.lit(float(s)) for s in shares]))
        part = part.groupBy(*by).agg(found.alias("_q"))
        return part.select(*by, *[F.col("_q")[i].cast("double").alias(n) for i, n in enumerate(names)])

    def busy(part: DataFrame) -> DataFrame:
        counts = part.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.withColumn("_bucket", log_bucket(F.col("_v")))
        ranked = running(counts, by, "_bucket", ["_v"], {"_upto": ("sum", F.col("_n"), True)})
        start = F.col("_upto") - F.col("_n")
        aggs = []
        for name, share in zip(names, shares):
            spot = (F.col("_upto_total") - 1) * F.lit(float(share))
            for side, index in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
                here = (start <= index) & (index < F.col("_upto"))
                aggs.append(F.max(F.when(here, F.col("_v"))).alias(f"{name}_{side}"))
        aggs.append(F.max("_upto_total").alias("_total"))
        found = ranked.groupBy(*by).agg(*aggs)
        out = []
        for name, share in zip(names, shares):
            spot = (F.col("_total") - 1) * F.lit(float(share))
            out.append(_interpolate(F.col(f"{name}_lo").cast("double"), F.col(f"{name}_hi").cast("double"),
                                    spot - F.floor(spot)).alias(name))
        return found.select(*by, *out)

    if not by:
        # One group: the whole input.
        return quantiles(rows.withColumn("_all", F.lit(0)), "_v", ["_all"], shares, rows_per_piece).drop("_all")
    return by_heat(rows, by, ordinary, busy, rows_per_piece)


def summary_columns(df: DataFrame, value: str, by: list[str], unit: float = 1.0,
                    with_p90: bool = False, rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Count, mean, median, p50, p95, p99, min, max and population deviation, in s and ms.

    ``value`` is divided by ``unit`` to get seconds.  Groups that exist but hold only null values give
    count 0 and zeros.
    """
    by = list(by)
    shares = [0.5, 0.95, 0.99] + ([0.9] if with_p90 else [])
    v = F.col(value)
    keys = by or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    moments = base.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("_mean"), F.min(v).alias("_min"),
        F.max(v).alias("_max"), F.stddev_pop(v).alias("_std"))
    found = quantiles(base, value, keys, shares, rows_per_piece)
    joined = moments.join(found, keys, "left")
    stats = {"mean": "_mean", "median": "q0", "p50": "q0", "p95": "q1", "p99": "q2",
             "min": "_min", "max": "_max", "std": "_std"}
    if with_p90:
        stats["p90"] = "q3"
    seconds = {n: F.coalesce(F.col(c).cast("double") / unit, F.lit(0.0)) for n, c in stats.items()}
    # p50 <= p95 <= p99 whatever the rounding of the interpolation
    seconds["p95"] = F.greatest(seconds["p50"], seconds["p95"])
    seconds["p99"] = F.greatest(seconds["p95"], seconds["p99"])
    out = joined.select(*by, "count", *[c.alias(f"{n}_seconds") for n, c in seconds.items()])
    return out.withColumns({f"{n}_ms": F.col(f"{n}_seconds") * 1000.0 for n in seconds})


COMPONENTS = ["collection", "prep", "infer", "e2e"]


def delay_benchmark(rows: DataFrame, by: list[str], rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """One flat row per benchmark from per-sample ``collection_s``, ``prep_s`` and ``infer_s``.

    End-to-end delay is the sum of the three on each row.  Collection and end-to-end are given in
    seconds, the other two in milliseconds; throughput is rows per second of inference.
    """
    rows = rows.withColumn("e2e_s", F.col("collection_s") + F.col("prep_s") + F.col("infer_s"))
    cells = [F.struct(F.lit(c).alias("component"), F.col(f"{c}_s").alias("_seconds")) for c in COMPONENTS]
    stats = summary_columns(rows.select(*by, F.inline(F.array(*cells))), "_seconds", [*by, "component"],
                            rows_per_piece=rows_per_piece)
    wide = []
    for name in COMPONENTS:
        unit = "seconds" if name in ("collection", "e2e") else "ms"
        wide += [F.max(F.when(F.col("component") == name, F.col(f"{stat}_{unit}"))).alias(f"{name}_{stat}_{unit}")
                 for stat in ("mean", "median", "p50", "p95", "p99", "min", "max", "std")]
    flat = stats.groupBy(*by).agg(*wide)
    return throughput(rows, by).join(flat, by).withColumn("batch_size", F.lit(1))


def throughput(rows: DataFrame, by: list[str], seconds: str = "infer_s") -> DataFrame:
    """Rows per second of ``seconds``, to two places; 0 where no time was spent."""
    total = F.sum(seconds)
    rate = F.when(total > 0, F.bround(F.count(F.lit(1)) / total, 2)).otherwise(F.lit(0.0))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("sample_count"),
                                 rate.alias("infer_throughput_samples_per_second"))
