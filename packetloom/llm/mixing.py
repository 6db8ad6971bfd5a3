"""Mixing sources to target weights.

Each source gets a word budget by weight, capped at a multiple of its size.  A source is taken in complete
epochs first; the rest of its budget goes to the documents with the smallest exponential keys (Efraimidis and
Spirakis), -ln(u) / quality, as far as their prefix sum of words reaches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.tables import SPACE, materialize, prefix_sums, text_or_empty

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_EPOCHS = 2.0
SEED = "mix-1"
SYMBOLS = r"[!-/:-@\[-`{-~]"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than white space."""
    marks = F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), SPACE, "")
    return F.char_length(marks).cast("long")


def quality_weight(text: Column) -> Column:
    """0.05 to 1: texts of many ASCII symbols weigh less; an empty text weighs 1."""
    chars = F.char_length(text)
    symbols = chars - F.char_length(F.regexp_replace(text, SYMBOLS, ""))
    return F.when(chars == 0, 1.0).otherwise(F.greatest(F.lit(0.05), 1 - 4 * symbols / chars))


def uniform(doc_id: Column, seed: str) -> Column:
    """A repeatable draw from (0, 1) for each id; null ids share one."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most_epochs: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights repeat over the sources by code point, null last.  A source wants weight x level words and gets at
    most ``most_epochs`` times its size; the level is the one at which the targets sum to the budget.  In order of
    size per weight the capped sources come first, so prefix sums find the level.
    """
    ranked = prefix_sums(sizes.withColumn("_one", F.lit(1)), [], [F.asc_nulls_last("source")], {"_rank": "_one"})
    turn = F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int")
    ranked = ranked.select("source", "source_size", "_rank",
                           F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1).alias("_weight"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(most_epochs)))
    ranked = prefix_sums(
        ranked.withColumn("_ratio", F.col("_cap") / F.col("_weight")), [], [F.asc("_ratio"), F.asc("_rank")],
        {"_caps": "_cap", "_weights": "_weight"})
    ranked = materialize(ranked)
    total = ranked.agg(F.sum("source_size").alias("words"), F.sum("_weight").alias("weight")).first()
    budget, weight = share * float(total.words or 0), total.weight or 1.0
    level = ((F.lit(budget) - (F.col("_caps") - F.col("_cap")))
             / (F.lit(weight) - (F.col("_weights") - F.col("_weight"))))
    open_ones = ranked.select("_ratio", "_rank", level.alias("_level")).filter(F.col("_ratio") > F.col("_level"))
    found = open_ones.agg(F.min_by("_level", F.struct("_ratio", "_rank")).alias("level")).first().level
    target = F.col("_cap") if found is None else F.least("_cap", F.col("_weight") * F.lit(found))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
        most_epochs: float = MOST_EPOCHS, seed: str = SEED, quality: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken (words, with repeats).

    The last document of the fractional part is taken if that brings the source nearer to its target, so a source
    misses it by at most half a document.  A null text has no words; documents without words count no words but
    are copied like others.  Null sources are one source, last in order.  Repeated rows are taken each by itself.
    Other columns are ignored; an empty table gives no rows.
    """
    text = text_or_empty()
    narrow = materialize(docs.select(
        "doc_id", "source", n_words(text).alias("size"),
        (-F.log(uniform(F.col("doc_id"), seed)) / (quality_weight(text) if quality is None else quality)).alias("key")))
    sizes = materialize(narrow.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = (materialize(source_targets(sizes, weights, share, most_epochs))
               .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                           .otherwise(0)))
    order = [F.asc("key"), F.asc_nulls_last("doc_id"), F.asc("size")]
    ranked = prefix_sums(narrow, ["source"], order, {"_reached": "size"})
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    chosen = (left > 0) & (F.col("_reached") - F.col("size") / 2 <= left)
    copies = (F.col("epochs") + F.when(chosen, 1).otherwise(0)).cast("long")
    targets = targets.withColumnRenamed("source", "_source")
    return (ranked.join(targets, F.col("source").eqNullSafe(F.col("_source")))
            .select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                    (copies * F.col("size")).alias("taken")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows that agree in doc_id (null included), source and size are taken alike: as often as any of them is.
    """
    taken = mix(docs, **options).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("_copies")).filter(
        "_copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
                              F.col("size").alias("_size"), "_copies")
    marked = docs.select("*", n_words(text_or_empty()).alias("_own_size"))
    return (marked.join(taken, marked["doc_id"].eqNullSafe(taken["_id"]) & (marked["_own_size"] == taken["_size"])
                        & marked["source"].eqNullSafe(taken["_source"]))
            .withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)"))).select(*[marked[c] for c in docs.columns]))
