"""Feature cleaning for ready-made flow-statistics tables."""

from __future__ import annotations

from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.names import feature_columns
from packetloom.operators.delay import quantiles
from packetloom.operators.ordered import one_row


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def numeric_or_null(column: str) -> Column:
    """Number of a cell; text that is no number, NaN and infinities become null."""
    x = F.col(f"`{column}`").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clean_features(df: DataFrame, label: str, keep: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """Numeric feature columns and their names; identifiers and columns without any number go.

    One aggregate over all columns finds the empty ones; a column of infinities only is kept, all null.
    """
    names = [c for c in feature_columns(df.columns, label) if c not in keep]
    parsed = {c: F.col(f"`{c}`").try_cast("double") for c in names}
    filled = df.agg(*[F.count(F.when(~F.isnan(x), x)).alias(c) for c, x in parsed.items()]).first()
    names = [c for c in names if filled[c] > 0]
    others = [c for c in (label, *keep) if c in df.columns]
    return df.select(*others, *[numeric_or_null(c).alias(c) for c in names]), names


def as_float32(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c in names})


def drop_incomplete(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows with a value in every feature."""
    return df.na.drop("any", subset=names)


def fit_medians(train: DataFrame, names: list[str]) -> DataFrame:
    """Exact median per feature of the training rows, as one row."""
    cells = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in names]
    long = train.select(F.inline(F.array(*cells)))
    found = quantiles(long, "v", ["name"], [0.5])
    return found.groupBy().pivot("name", names).agg(F.first("q0"))


def impute(df: DataFrame, medians: DataFrame, names: list[str]) -> DataFrame:
    fitted = one_row(medians)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), fitted[c]) for c in names})


def imputer_stage(names: list[str]) -> Imputer:
    """The approximate median imputer of Spark ML, for use inside a pipeline."""
    return Imputer(strategy="median", inputCols=names, outputCols=names, relativeError=1e-4)


def vector_stages(names: list[str], scaled: bool) -> list:
    """Stages that end in ``features``; ``scaled`` centres and scales on the rows it is fitted on."""
    raw = "_vector" if scaled else "features"
    stages = [VectorAssembler(inputCols=names, outputCol=raw, handleInvalid="keep")]
    if scaled:
        stages.append(StandardScaler(inputCol=raw, outputCol="features", withMean=True, withStd=True))
    return stages
