"""Merkle manifest of a document table: one root digest, and for every row a proof that it belongs to it.

Digests of a group stand in order, dealt into aligned blocks of ``BLOCK`` places.  A block keeps each of its levels
as one hex string: fixed-width substrings of a level are the pairs whose digests form the next one, and the substring
beside a place is its sibling.  The top digests of blocks are the digests of the next tier, until each group has one;
the groups' digests, in the order of their names, are climbed in the same way to the root.  No task holds more than
one block at a time, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.tables import materialize, prefix_sums

# Places of a block; a power of two, so that no pair crosses blocks.
LEVELS = 8
BLOCK = 1 << LEVELS

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass
class Manifest:
    """Tables of blocks, leaves first: tiers within groups, then tiers over the groups' digests."""
    within: list[DataFrame]
    across: list[DataFrame]


def encoded(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value: no two lists of fields give the same text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(
        F.when(step["left"], F.concat(step["digest"], node)).otherwise(F.concat(node, step["digest"])), 256))


def siblings(path: Column) -> Column:
    """The siblings of ``path`` as one hex string, level by level."""
    return F.array_join(F.transform(path, lambda step: step["digest"]), "")


def build(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id",
          keep: Sequence[Column] = ()) -> Manifest:
    """The manifest of ``docs``: a leaf per row from ``fields``, ascending by ``order`` within ``group``.

    Nulls are encoded apart from every value; a null group is a group of its own and comes first, null in ``order``
    comes first too.  Rows that tie in ``order`` stand by their leaf, so the root does not depend on how the table is
    stored; equal rows are separate leaves.  ``keep`` are columns (over the input) to carry beside each leaf.  Other
    columns are ignored; an empty table has blocks of nothing.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = docs.select(F.col(order).alias("id"), named.alias("name"),
                         leaf_digest([F.col(f) for f in fields]).alias("digest"),
                         F.struct(F.col(order).alias("id"), *keep).alias("kept"), F.lit(1).alias("one"))
    placed = prefix_sums(leaves, ["name"], [F.asc_nulls_first("id"), F.asc("digest")], {"place": "one"})
    within = _climb(placed.select("name", (F.col("place") - 1).alias("place"), "digest", "kept"))
    tops = within[-1].select(F.col("name").alias("of"), F.col("top").alias("digest"), F.lit(1).alias("one"))
    across = prefix_sums(tops, [], [F.asc("of")], {"place": "one"})
    return Manifest(within, _climb(across.select(
        F.lit("").alias("name"), (F.col("place") - 1).alias("place"), "digest", F.struct("of").alias("kept"))))


def proofs(manifest: Manifest) -> DataFrame:
    """One row per leaf: the kept columns, leaf, subroot (of its group), root, path.

    ``path`` lists what stands beside the leaf and then beside each digest above it: (left, digest), with an empty
    digest where a place has no neighbour.
    """
    nothing = F.expr("cast(array() as array<struct<left: boolean, digest: string>>)")
    groups = manifest.across[-1].select(
        "name", "block", F.col("top").alias("root"), nothing.alias("path"), F.col("top").alias("subroot"))
    for blocks in reversed(manifest.across):
        groups = _descend(blocks, groups)
    rest = groups.select(F.col("kept.of").alias("name"), F.lit(0).cast("long").alias("block"), "root", "path",
                         F.col("digest").alias("subroot"))
    for blocks in reversed(manifest.within):
        rest = _descend(blocks, rest)
    return rest.select("kept.*", F.col("digest").alias("leaf"), "subroot", "root", "path")


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """Tables of blocks over (name, place, digest, kept), each over the tops of the one before it, to one per name."""
    tiers = []
    while True:
        blocks = materialize(_blocks(nodes))
        tiers.append(blocks)
        if not blocks.agg(F.max("block")).first()[0]:
            return tiers
        nodes = blocks.select("name", F.col("block").alias("place"), F.col("top").alias("digest"),
                              F.lit(None).cast("string").alias("kept"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """(name, block, members, levels, top) of aligned blocks; a name of one block climbs only as far as it must."""
    rows = nodes.groupBy("name", F.floor(F.col("place") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("place", "digest", "kept"))).alias("members"),
        F.max("place").alias("last"))
    ends = rows.groupBy("name").agg(F.max("last").alias("end"))
    height = F.when(F.col("end") >= BLOCK, LEVELS).when(F.col("end") == 0, 0).otherwise(F.length(F.bin("end")))
    sized = (rows.join(ends, "name").withColumn("steps", F.slice(F.sequence(F.lit(1), F.lit(LEVELS)), 1, height))
             .withColumn("base", F.array(F.array_join(F.transform("members", lambda m: m["digest"]), ""))))
    levels = F.expr("""aggregate(steps, base, (done, step) -> concat(done, array(array_join(transform(
        sequence(0, (length(element_at(done, -1)) - 1) div 128),
        pair -> sha2(substring(element_at(done, -1), pair * 128 + 1, 128), 256)), ''))))""")
    return sized.withColumn("levels", levels).select(
        "name", "block", "members", "levels", F.element_at("levels", -1).alias("top"))


def _descend(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Each member of ``blocks`` with its path: beside it in its block, then what ``above`` says of the block."""
    beside = F.expr("""explode(transform(members, (own, at) -> struct(own.place as place, own.digest as digest,
        own.kept as kept, concat(transform(slice(levels, 1, size(levels) - 1), (level, up) -> struct(
            shiftright(at, up) % 2 = 1 as left,
            substring(level, (shiftright(at, up) ^ 1) * 64 + 1, 64) as digest)), path) as path)))""")
    members = (blocks.select("name", "block", "members", "levels").join(above, ["name", "block"])
               .select("name", "root", "subroot", beside.alias("own")).select("name", "root", "subroot", "own.*"))
    return members.withColumn("block", F.col("place"))
