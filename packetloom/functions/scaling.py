"""Scaling of clump fields and the vectors made from them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The step that fills a short window.
PADDING = [-1.0, -1.0, -1.0, -1.0, 0.0]


def scale_time(seconds: Column) -> Column:
    """log10 of 1e-12 s .. 1e-2 s onto 0..1; longer times go above 1."""
    return (F.log10(F.greatest(F.lit(1e-12), seconds.cast("double"))) + 12.0) / 10.0


def scale_size(size: Column) -> Column:
    """log10 of bytes, capped at 1e4, with 10^0.5 at 0 and 1e4 at 1."""
    bounded = F.least(F.lit(1e4), F.greatest(F.lit(1e-12), size.cast("double")))
    return (F.log10(bounded) - 0.5) / 3.5


def scale_count(count: Column) -> Column:
    """log2 of a whole count between 1 and 256, onto 0..1."""
    return F.log2(F.least(F.lit(256), F.greatest(F.lit(1), count.cast("long"))).cast("double")) / 8.0


def direction_sign(direction: Column) -> Column:
    """0 -> 1, 1 and -1 -> -1; anything else fails the job."""
    bad = F.raise_error(F.concat(F.lit("invalid clump direction: "), direction.cast("string")))
    return (F.when(direction == 0, F.lit(1.0)).when(direction.isin(1, -1), F.lit(-1.0))
            .otherwise(bad.cast("double")))


def clump_vector(scaled: bool = True) -> Column:
    """[interarrival, duration, size, packet count, direction] of a clump row."""
    gap, span = F.col("interarrival_us") / 1e6, F.col("duration_us") / 1e6
    if scaled:
        return F.array(scale_time(gap), scale_time(span), scale_size(F.col("size")),
                       scale_count(F.col("pkt_count")), direction_sign(F.col("direction")))
    return F.array(gap, span, F.col("size").cast("double"), F.col("pkt_count").cast("double"),
                   F.col("direction").cast("double"))


def vector_of(step: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in step])


def step_mask(features: Column, padding: list[float] = PADDING) -> Column:
    """1.0 for real steps of a window, 0.0 for padding."""
    pad = vector_of(padding)
    return F.transform(features, lambda step: F.when(step == pad, F.lit(0.0)).otherwise(F.lit(1.0)))


def tolerant_mask(features: Column, padding: list[float] = PADDING,
                  absolute: float = 1e-4, relative: float = 1e-5) -> Column:
    """``step_mask`` within a tolerance; a window of padding only keeps all its steps."""
    pad = vector_of(padding)

    def near(step: Column) -> Column:
        close = F.zip_with(step, pad, lambda a, b: F.abs(a - b) <= absolute + relative * F.abs(b))
        return F.forall(close, lambda ok: ok)

    mask = F.transform(features, lambda step: F.when(near(step), F.lit(0.0)).otherwise(F.lit(1.0)))
    return F.when(F.exists(mask, lambda m: m > 0.5), mask).otherwise(
        F.transform(features, lambda _: F.lit(1.0)))


def sigmoid(x: Column) -> Column:
    """Logistic curve in the form that never overflows."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def default_label_name(layer: Column, label: Column) -> Column:
    return (F.when(layer == 1, F.when(label == 1, F.lit("doh")).otherwise(F.lit("non_doh")))
            .otherwise(F.when(label == 1, F.lit("malicious_doh")).otherwise(F.lit("benign_doh"))))
