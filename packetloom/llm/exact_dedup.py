"""Exact deduplication by content sort.

Texts without white space are dealt out by sampled ranges of their leading characters and hash, sorted outside
memory, and compared in full with their neighbours; the best row of each run of equal texts stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.tables import SPACE, hot_keys, materialize, one_of_each, text_or_empty

# A run of equal texts above this many rows is sorted in pieces of about this size.
ROWS_PER_PIECE = 256

# Leading characters of a text in the range key: splitters are held by the driver, so they must be short.
LEAD_CHARS = 32


def equal_texts(docs: DataFrame, rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal if they are identical without white space.  The row with the most code points in the
    original text stays, then that with the smallest doc_id (null last).  A null text is empty; empty texts are
    equal to each other.  Of repeated rows (same doc_id and text) one is kept.  Other columns are ignored; an
    empty table gives no rows.
    """
    rows = (docs.select("doc_id", text_or_empty().alias("_text"))
            .select("doc_id", F.char_length("_text").alias("n_chars"),
                    F.regexp_replace("_text", SPACE, "").alias("norm"))
            .withColumn("h", F.xxhash64("norm")))
    keyed = (rows.join(hot_keys(rows.select("h"), "h", rows_per_piece), "h", "left")
             .withColumn("pieces", F.coalesce("pieces", F.lit(1)))
             .withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.col("pieces")))
             .withColumn("lead", F.substring("norm", 1, LEAD_CHARS)))
    # The window asks for (lead, h, piece, norm) together, which ranges of (lead, h, piece) give: one exchange.
    run = Window.partitionBy("lead", "h", "piece", "norm")
    best_first = run.orderBy(F.desc("n_chars"), F.asc_nulls_last("doc_id"))
    whole = best_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pieces = materialize(keyed.repartitionByRange("lead", "h", "piece").select(
        "doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"), "pieces", "piece",
        F.first("doc_id").over(whole).alias("keep_id"), F.first("n_chars").over(whole).alias("keep_chars"),
        F.count(F.lit(1)).over(whole).alias("group_size"), F.row_number().over(best_first).alias("place")))
    whole_runs = pieces.filter("pieces = 1").withColumn("kept", F.col("place") == 1)
    return (whole_runs.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_chars")
            .unionByName(_join_pieces(pieces.filter("pieces > 1"))))


def _join_pieces(rows: DataFrame) -> DataFrame:
    """Rows of runs that were sorted in pieces: the best of the pieces' best rows stays."""
    heads = rows.filter("place = 1").select("text_sha256", "piece", "keep_id", "keep_chars", "group_size")
    rank = F.struct(-F.col("keep_chars"), F.col("keep_id").isNull(), F.col("keep_id"))
    runs = heads.groupBy("text_sha256").agg(
        F.sum("group_size").alias("group_size"), F.min_by("piece", rank).alias("_piece"),
        F.min_by("keep_id", rank).alias("keep_id"))
    heads = heads.select("text_sha256", "piece").join(runs, "text_sha256")
    return (rows.drop("keep_id", "group_size").join(heads, ["text_sha256", "piece"])
            .select("doc_id", "keep_id", "group_size",
                    ((F.col("place") == 1) & (F.col("piece") == F.col("_piece"))).alias("kept"), "text_sha256",
                    "n_chars"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row is known by doc_id (null included), text without white space and length; of rows that agree in all of
    them one stays.
    """
    kept = materialize(equal_texts(docs).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("n_chars").alias("_n")))
    marked = docs.select("*", F.sha2(F.regexp_replace(text_or_empty(), SPACE, ""), 256).alias("_own_sha"),
                         F.char_length(text_or_empty()).alias("_own_n"))
    found = marked.join(kept, marked["doc_id"].eqNullSafe(kept["_id"]) & (marked["_own_sha"] == kept["_sha"])
                        & (marked["_own_n"] == kept["_n"]), "left_semi")
    return one_of_each(found, marked, ["doc_id", "_own_sha", "_own_n"]).select(*docs.columns)
