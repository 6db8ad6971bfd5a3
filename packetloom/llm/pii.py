"""Personal data and the terms that give it away.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers: the protected entities.  The corpus then
tells which terms of the documents that hold them disclose them: a term whose pointwise mutual information with an
entity, at the lower bound of its confidence interval, is most of the entity's information content all but names it.
Entities are generalised; such terms are generalised or, the strongest, removed wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.tables import bit_is_set, hot_keys, materialize, text_or_empty

# Share of an entity's information that a term must carry to be generalised, and to be removed.
DISCLOSING, REMOVED = 0.8, 0.95
# Normal quantile of the one-sided bound (95%) on how often the entity is in a document that has the term.
SURE = 1.645
# The filter of disclosing terms is this many bitmaps of as many bits; a term has one bitmap, and a bit in it for each seed.
BITMAPS, BITS = 1 << 10, 1 << 15
SEEDS = (1, 2, 3)

TERM = r"\p{L}[\p{L}\p{N}]{2,}"
KINDS = ("email", "ip", "card", "phone")
# The patterns of the kinds, written so that no start inside a run is tried again and again: a match can only begin
# where its first run begins or where the last match ended, and runs are not given back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
SMALL_NUMBER = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def matches(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost matches that do not overlap, as structs of start, end (code points, end exclusive) and value.

    Splitting by the pattern gives what lies between the matches, so summed lengths give the places.  With ``keep``
    only the matches whose value it holds for are listed.
    """
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    kind = "struct<at:int,found:array<struct<start:int,end:int,value:string>>>"
    start = F.from_json(F.lit('{"at":0,"found":[]}'), kind)

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + F.char_length(m["gap"])
        end = begin + F.char_length(m["value"])
        longer = F.concat(acc["found"], F.array(F.struct(begin.alias("start"), end.alias("end"),
                                                         m["value"].alias("value"))))
        if keep is not None:
            longer = F.when(keep(m["value"]), longer).otherwise(acc["found"])
        return F.when(m["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), longer.alias("found")))
    return F.aggregate(both, start, step, lambda acc: acc["found"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def part(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda s, i: s + part(i)) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{SMALL_NUMBER}(?:\.{SMALL_NUMBER}){{3}}$")
    if kind == "card":
        return F.char_length(_digits(value)).between(12, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


def entities(text: Column) -> Column:
    """All entities of a text as structs of start, place (of the kind), end, kind, value, by start then kind."""
    shape = "array<struct<start:int,place:int,end:int,kind:string,value:string>>"

    def of(place: int, kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind]), lambda m: _passes(kind, m["value"]))
        spans = F.transform(found, lambda m: F.struct(m["start"], F.lit(place).alias("place"), m["end"],
                                                      F.lit(kind).alias("kind"), m["value"]))
        return F.when(text.rlike(HINTS[kind]), spans.cast(shape)).otherwise(F.array().cast(shape))
    return F.array_sort(F.concat(*[of(i, k) for i, k in enumerate(KINDS)]))


def _content(text: Column) -> Column:
    return F.xxhash64(text)


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, content (a hash of the text) and spans (entities) of every row, as a written table."""
    text = text_or_empty()
    return materialize(docs.select("doc_id", _content(text).alias("content"), entities(text).alias("spans")))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _lower_bound(hits: Column, of: Column) -> Column:
    """Wilson's lower bound on a share of which ``hits`` in ``of`` were seen."""
    p, z = hits / of, SURE * SURE
    return (p + z / (2 * of) - SURE * F.sqrt(p * (1 - p) / of + z / (4 * of * of))) / (1 + z / of)


def disclosing_terms(docs: DataFrame, found: DataFrame, disclosing: float = DISCLOSING) -> DataFrame:
    """(term, share): terms that carry at least ``disclosing`` of some entity's information, with the largest share.

    Probabilities are shares of different whole texts over the whole corpus; copies count once on both sides.  A term
    qualifies by the lower bound of its mutual information, so one shared text is weak evidence in a small corpus and
    enough in a large one; ``share`` is the plain estimate.
    """
    copies = hot_keys(found, "content", 1).withColumnRenamed("pieces", "copies")
    n_texts = float(max(found.count() - (copies.agg(F.sum(F.col("copies") - 1)).first()[0] or 0), 1))
    held = materialize(found.filter(F.size("spans") > 0).select("content", F.explode("spans").alias("s"))
                       .select("content", "s.kind", "s.value").distinct())
    # Entities of the same texts have the same counts with every term, and terms of the same texts with every entity:
    # each set of texts counts once.
    sets = held.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_entity"), F.bit_xor(
        F.xxhash64("content", F.lit("entity"))).alias("entity"))
    holders = materialize(held.join(sets, ["kind", "value"]).select("content", "entity", "n_entity").distinct())
    most = holders.agg(F.max("n_entity")).first()[0] or 0
    # A share never exceeds n_entity / n_term, so more frequent terms cannot qualify.
    limit = float(most) ** disclosing * n_texts ** (1 - disclosing) * (1 + 1e-9)

    text = text_or_empty()
    words = docs.select(_content(text).alias("content"), _terms(text).alias("terms"))
    counted = (words.join(copies, "content", "left")
               .select(F.explode("terms").alias("term"), (1 / F.coalesce("copies", F.lit(1))).alias("part"))
               .groupBy("term").agg(F.round(F.sum("part")).alias("n_term")).filter(F.col("n_term") <= limit))
    inside = (words.join(held.select("content").distinct(), "content", "left_semi")
              .select("content", F.explode("terms").alias("term")).distinct())
    places = materialize(inside.join(counted, "term"))
    terms = materialize(places.groupBy("term", "n_term").agg(F.bit_xor(
        F.xxhash64("content", F.lit("term"))).alias("texts")))
    groups = places.join(terms.select("term", "texts"), "term").select("content", "texts", "n_term").distinct()
    joint = groups.join(holders, "content").filter(
        F.col("n_term") <= F.pow("n_entity", F.lit(disclosing)) * n_texts ** (1 - disclosing) * (1 + 1e-9)).groupBy(
        "texts", "n_term", "entity", "n_entity").agg(F.count(F.lit(1)).alias("n_both"))
    information = F.log(F.lit(n_texts)) - F.log("n_entity")

    def share(hits: Column) -> Column:
        return F.when(information > 0, 1 + F.log(hits) / information).otherwise(0.0)
    sure = share(_lower_bound(F.col("n_both"), F.col("n_term"))) >= disclosing
    best = joint.filter(sure).groupBy("texts", "n_term").agg(
        F.max(share(F.col("n_both") / F.col("n_term"))).alias("share"))
    return materialize(terms.join(best, ["texts", "n_term"]).select("term", "share"))


def _filter(terms: DataFrame) -> DataFrame:
    """(bitmap, bits): a filter of bounded size that passes every one of ``terms`` and few others, as a written table.

    It is broadcast as a table.  As a value inside an expression it would be part of every task's code, copy by copy,
    all of which the driver holds.
    """
    places = terms.select(_bitmap(F.col("term")), F.explode(F.array(*[_bit(F.col("term"), s) for s in SEEDS])).alias("bit"))
    return materialize(places.groupBy("bitmap").agg(F.bitmap_construct_agg("bit").alias("bits")))


def _bitmap(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BITMAPS)).alias("bitmap")


def _bit(term: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(term, F.lit(seed)), F.lit(BITS))


def _passing(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``term`` is not among ``terms``."""
    held = reduce(lambda a, b: a & b, [bit_is_set(F.col("bits"), _bit(F.col("term"), s)) for s in SEEDS])
    return (rows.withColumn("bitmap", _bitmap(F.col("term"))).join(F.broadcast(_filter(terms)), "bitmap")
            .filter(held).select(*rows.columns))


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(content, start, end, share) of every occurrence of ``terms`` in every text; copies of a text give one row."""
    text = text_or_empty()
    rows = docs.select(_content(text).alias("content"), text.alias("text"))
    listed = (_passing(rows.select("content", F.explode(_terms(F.col("text"))).alias("term")), terms)
              .distinct().join(terms, "term"))
    wanted = materialize(listed.groupBy("content").agg(F.map_from_entries(F.collect_list(F.struct(
        "term", "share"))).alias("shares")))
    # Copies meet in their input splits first, so a text with many copies is no large group.
    found = matches(F.col("text"), TERM, lambda value: F.map_contains_key("shares", F.lower(value)))
    return (rows.dropDuplicates(["content"]).join(wanted, "content")
            .select("content", "shares", F.explode(found).alias("m"))
            .select("content", "m.start", "m.end", F.try_element_at("shares", F.lower("m.value")).alias("share")))


def spans(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base and all_spans of every row: base entities, and these with the terms that disclose them.

    Spans are structs of start, place, end, kind (term and removed for disclosing terms), by start, then kind.  A null
    or empty text has none.  Repeated rows get equal spans.  Other columns are ignored; an empty table gives no rows.
    """
    return _located(docs, **options).drop("content")


def _located(docs: DataFrame, **options) -> DataFrame:
    found = mentions(docs)
    terms = disclosing_terms(docs, found, **options)
    added = materialize(
        occurrences(docs, terms).withColumn("kind", F.when(F.col("share") >= REMOVED, "removed").otherwise("term"))
        .groupBy("content").agg(F.collect_list(F.struct(
            "start", F.lit(len(KINDS)).alias("place"), "end", "kind")).alias("added")))
    base = F.transform("spans", lambda s: F.struct(s["start"], s["place"], s["end"], s["kind"]))
    apart = F.filter("added", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    return found.join(added, "content", "left").select(
        "doc_id", "content", base.alias("base"),
        F.array_sort(F.concat(base, F.coalesce(apart, none))).alias("all_spans"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with texts in which entities and disclosing terms are generalised to their kind, the strongest removed.

    Of overlapping spans the first counts.  Texts without spans, null ones too, stay as they are.
    """
    marks = (_located(docs, **options).filter(F.size("all_spans") > 0).dropDuplicates(["content"])
             .select(F.col("content").alias("_content"), F.col("all_spans").alias("_spans")))
    text = text_or_empty()
    begin = F.from_json(F.lit('{"at":0,"out":""}'), "struct<at:int,out:string>")

    def step(acc: Column, s: Column) -> Column:
        label = F.when(s["kind"] == "removed", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), label).alias("out")))
    whole = F.aggregate("_spans", begin, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return (docs.withColumn("_key", _content(text)).join(marks, F.col("_key") == F.col("_content"), "left")
            .withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(whole))
            .select(*docs.columns))
