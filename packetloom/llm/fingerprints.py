"""Document fingerprints by one-permutation MinHash.

A document's 5-word shingles are hashed once; the leading bits of a hash name its bin and each bin keeps its smallest
hash.  An empty bin takes over the bin that comes first in its own fixed probing order (optimal densification), and
the low bits of all bins are packed.  Likeness is the share of equal bins, corrected for chance agreement.
"""

from __future__ import annotations

from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.tables import WORD, materialize, text_or_empty

WORDS = 5
BIN_BITS, VALUE_BITS, LOW_BITS = 8, 40, 4
BINS = 1 << BIN_BITS
EMPTY = (1 << VALUE_BITS) - 1
IN_A_LONG = 64 // LOW_BITS
PROBES = 6

# Neighbouring documents meet in buckets of about this many rows; there are at most MOST_BUCKETS of even width.
ROWS_PER_BUCKET = 128
MOST_BUCKETS = 1 << 16


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _probe(bin_no: int, turn: int) -> int:
    return xxhash.xxh64_intdigest(f"{bin_no}:{turn}") % BINS


def _filled(code: Column) -> Column:
    return code.bitwiseAND(F.lit(EMPTY)) != EMPTY


def _bins(words: Column) -> Column:
    """The smallest hash of each bin, with the bin in front; value bits all set where a bin is empty."""
    def hashes(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(w) - (WORDS - 1), F.lit(1)))
        return F.transform(places, lambda i: F.xxhash64(F.slice(w, i, WORDS))
                           .bitwiseAND(F.lit((1 << (BIN_BITS + VALUE_BITS)) - 1)))
    ends = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)),
                       lambda b: F.shiftleft(b.cast("long"), VALUE_BITS).bitwiseOR(F.lit(EMPTY)))
    ordered = F.sort_array(F.concat(_let(words, hashes), ends))
    return _let(ordered, lambda s: F.filter(s, lambda x, i: (i == 0) | (
        F.shiftright(x, VALUE_BITS) != F.shiftright(F.get(s, i - 1), VALUE_BITS))))


def _densified(bins: Column) -> Column:
    """Every empty bin filled from the first non-empty bin of its probing order.

    The order is PROBES hashed tries, then all bins by a hash of the two, so it always ends.
    """
    tries = [F.array(*[F.lit(_probe(b, t)) for b in range(BINS)]) for t in range(PROBES)]

    def fill(b: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            rest = F.array_min(F.transform(F.filter(b, _filled), lambda y: F.struct(
                F.xxhash64(i, F.shiftright(y, VALUE_BITS)).alias("p"), y.alias("y"))))["y"]
            found = F.when(_filled(x), x)
            for places in tries:
                other = F.get(b, F.get(places, i))
                found = found.when(_filled(other), other)
            return found.otherwise(rest)
        return F.transform(b, one)
    return _let(bins, fill)


def packed_bits(text: Column) -> Column:
    """The low bits of all bins as an array of longs; an empty array for a text without words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))

    def pack(d: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // IN_A_LONG - 1)), lambda g: F.aggregate(
            F.slice(d, g * IN_A_LONG + 1, IN_A_LONG), F.lit(0).cast("long"),
            lambda acc, x: F.shiftleft(acc, LOW_BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("long")))))
    return _let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<long>"))
                .otherwise(_let(_densified(_bins(w)), pack)))


def as_hex(packed: Column) -> Column:
    return F.lower(F.array_join(F.transform(packed, lambda p: F.lpad(F.hex(p), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard of two packed fingerprints: 0 to 1; two empty ones are alike, one empty one is not."""
    def differing(x: Column) -> Column:
        any_bit = x
        for i in range(1, LOW_BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, i))
        return F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << LOW_BITS)
    estimate = ((1 - apart / BINS) - chance) / (1 - chance)
    return (F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double"))
            .otherwise(F.greatest(F.lit(0.0), estimate)))


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with fingerprint (string) and packed (its longs).  A null or empty text has the fingerprint ''."""
    return docs.withColumn("packed", packed_bits(text_or_empty())).withColumn("fingerprint", as_hex(F.col("packed")))


def _bucketed(docs: DataFrame) -> DataFrame:
    """``docs`` with bucket and part: runs of ascending doc_id of about ROWS_PER_BUCKET rows; null ids come last.

    Buckets are of even width over the range of ids; one that holds far more rows than meant is cut again by its own
    range.
    """
    ends = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("n")).first()
    low, high, n = ends.low or 0, ends.high or 0, ends.n
    width = -(-(high - low + 1) // max(1, min(MOST_BUCKETS, n // ROWS_PER_BUCKET)))
    big = F.col("doc_id").cast("decimal(38,0)")
    bucket = F.coalesce(F.floor((big - F.lit(low)) / F.lit(width)).cast("long"), F.lit(MOST_BUCKETS + 1))
    placed = docs.withColumn("bucket", bucket)
    meant = max(ROWS_PER_BUCKET, n // MOST_BUCKETS)
    counts = placed.groupBy("bucket").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("first"),
                                          (F.max("doc_id") - F.min("doc_id") + 1).alias("span"))
    crowded = materialize(counts.filter(F.col("n") > 4 * meant).select(
        "bucket", "first", F.ceil(F.col("span") / F.ceil(F.col("n") / meant)).alias("step")))
    return (placed.join(crowded, "bucket", "left")
            .withColumn("part", F.coalesce(F.floor((F.col("doc_id") - F.col("first")) / F.col("step")), F.lit(0)))
            .drop("first", "step"))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with next_<column> of the row that follows by doc_id (null last, then by text); the last one's is the
    first row's.

    A bucket's rows meet in one task.  Its last row needs the first row of the next bucket, which is sent to both;
    the list of first ids has at most about 2 * MOST_BUCKETS rows and is broadcast.
    """
    placed = _bucketed(docs)
    firsts = materialize(_bucketed(docs.select("doc_id")).groupBy("bucket", "part").agg(F.min("doc_id").alias("id")))
    order = Window.orderBy("bucket", "part")
    last = F.struct(F.last("bucket").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("bucket"),
                    F.last("part").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("part"))
    before = F.struct(F.lag("bucket").over(order).alias("bucket"), F.lag("part").over(order).alias("part"))
    guests = firsts.select("id", F.when(F.row_number().over(order) == 1, last).otherwise(before).alias("to"))
    guests = guests.select(F.col("id").alias("_id"), F.struct(F.col("to.bucket").alias("bucket"),
                                                             F.col("to.part").alias("part"), F.lit(True).alias("guest"))
                           .alias("_guest"))
    here = F.struct("bucket", "part", F.lit(False).alias("guest"))
    rows = (placed.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
            .withColumn("at", F.explode(F.array_compact(F.array(here, F.col("_guest")))))
            .select(*docs.columns, "at.bucket", "at.part", "at.guest"))
    following = Window.partitionBy("bucket", "part").orderBy("guest", F.asc_nulls_last("doc_id"), "text")
    return (rows.select(*docs.columns, "guest", *[F.lead(c).over(following).alias(f"next_{c}") for c in columns])
            .filter("NOT guest").drop("guest"))


def edited_texts(text: Column, following: Column) -> Column:
    """``text`` with its last quarter (rounded down) replaced by as many first characters of ``following``."""
    quarter = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - quarter), F.substring(following, F.lit(1), quarter))


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprints of each text and of its edited text, and how alike they and the next one's are.

    Only doc_id and text are read.  A null text is empty; an empty text has the fingerprint '' and likeness 1 to
    another empty one, 0 to others.  Rows of equal doc_id follow each other by text; a single row follows itself.
    """
    marked = with_fingerprints(docs.select("doc_id", text_or_empty().alias("text")))
    rows = with_next(marked, ["text", "packed"])
    rows = rows.withColumn("edited", edited_texts(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_packed", packed_bits(F.col("edited")))
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", as_hex(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"))
