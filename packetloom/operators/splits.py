"""Train/validation/test splits, leakage reports, class weights and train-only scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.scaling import PADDING, vector_of
from packetloom.operators.labels import require_classes
from packetloom.operators.ordered import hash_cut, materialize, one_row, running, seeded_hash

PARTS = ["train", "val", "test"]


class ImpossibleSplit(ValueError):
    """The data cannot be split as asked."""


def split_stratified(df: DataFrame, label: str = "label", ident: str = "sample_id", train: float = 0.8,
                     seed: int = 42, unit: str | None = None) -> DataFrame:
    """Random train/test split with every class divided alike.

    The test part of a class has max(1, round(n * (1 - train))) rows, half to even.  ``ident`` may be a
    window id, which lets windows of one flow fall on both sides; with ``unit="flow_id"`` whole flows
    are drawn instead (one class per flow).
    """
    if not 0.0 < train < 1.0:
        raise ValueError("train must be between 0 and 1")
    drawn = df if unit is None else df.select(unit, label).distinct()
    marked = hash_cut(drawn, label, unit or ident, seed, _train_counts(drawn, label, train), "_train")
    marked = marked.withColumn("split", F.when(F.col("_train"), "train").otherwise("test")).drop("_train")
    return marked if unit is None else df.join(marked, [unit, label])


def _train_counts(df: DataFrame, label: str, train: float) -> dict:
    """Rows of each class in the train part."""
    try:
        counts = require_classes(df, label, 2, 2)
    except ValueError as problem:
        raise ImpossibleSplit(str(problem)) from problem
    return {name: n - min(n - 1, max(1, round(n * (1.0 - train)))) for name, n in counts.items()}


def split_nested(df: DataFrame, label: str = "label", ident: str = "sample_id", seed: int = 42,
                 test: float = 0.2, val_of_rest: float = 0.25) -> DataFrame:
    """60/20/20: an outer stratified test part, then validation drawn from the rest.

    Both cuts are found on a written table of ids and labels; ``df`` is read once more, to be marked.
    """
    ids = materialize(df.select(ident, label))
    outer = _train_counts(ids, label, 1.0 - test)
    rest = materialize(hash_cut(ids, label, ident, seed, outer, "_rest").filter("_rest").drop("_rest"))
    inner = _train_counts(rest, label, 1.0 - val_of_rest)
    marked = hash_cut(df, label, ident, seed, outer, "_rest", ids)
    marked = hash_cut(marked, label, ident, seed + 1, inner, "_fit", rest)
    part = F.when(~F.col("_rest"), "test").when(F.col("_fit"), "train").otherwise("val")
    return marked.withColumn("split", part).drop("_rest", "_fit")


def session_table(df: DataFrame, label: str, session: str) -> DataFrame:
    """Rows per session and class: what the session splits decide on."""
    return df.groupBy(session, label).agg(F.count(F.lit(1)).alias("n"))


def class_reach(df: DataFrame, label: str = "label", session: str = "session_id", least: int = 3) -> DataFrame:
    """Sessions and rows per class, and whether the class reaches the ``least`` sessions a three-way split needs."""
    return (session_table(df, label, session).groupBy(label)
            .agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("rows"))
            .withColumn("enough", F.col("sessions") >= least))


def _check_sessions(df: DataFrame, table: DataFrame, label: str, session: str) -> int:
    """The number of classes; raises if sessions or classes are too few for three parts."""
    if not df.filter(F.col(session).isNull() | (F.col(session) == "")).isEmpty():
        raise ValueError(f"rows without {session} cannot be split by session")
    sessions = table.select(session).distinct().count()
    if sessions < 3:
        raise ImpossibleSplit(f"needs at least 3 sessions, found {sessions}")
    per_class = table.groupBy(label).agg(F.count(F.lit(1)).alias("sessions"))
    found = per_class.agg(F.count(F.lit(1)).alias("classes"), F.count_if(F.col("sessions") < 3).alias("rare")).first()
    if found.classes < 2:
        raise ImpossibleSplit(f"needs at least 2 classes, found {found.classes}")
    if found.rare:
        some = [r[label] for r in per_class.filter("sessions < 3").orderBy(label).limit(20).collect()]
        raise ImpossibleSplit(f"{found.rare} classes appear in under 3 sessions, among them {some}")
    return found.classes


def split_session_disjoint(df: DataFrame, label: str = "label", session: str = "session_id",
                           train: float = 0.70, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """No session in two parts, every class in every part, sizes near the ratios.

    One rule for any number of sessions, decided on the table of rows per (session, class).  For each part in turn,
    every class gives its largest session not taken yet, those first of which it is the rarest class.  All other
    sessions, in seeded hash order, fill what the parts still lack: a session goes where the middle of its rows falls.
    """
    ratios = dict(zip(PARTS, (train, val, test)))
    if abs(sum(ratios.values()) - 1.0) > 1e-6 or min(ratios.values()) <= 0:
        raise ValueError("ratios must be positive and add to 1")
    table = materialize(session_table(df, label, session))
    classes = _check_sessions(df, table, label, session)
    sizes = materialize(table.groupBy(session).agg(F.sum("n").alias("size")))
    covering = _covering(table, sizes, label, session, classes)
    covered = {r.split: r.rows for r in covering.groupBy("split").agg(F.sum("size").alias("rows")).collect()}
    total = sizes.agg(F.sum("size")).first()[0]
    lacking = [max(0.0, ratios[p] * total - covered[p]) for p in PARTS]

    name = F.col(session).cast("string")
    rest = (sizes.join(covering.select(session), session, "left_anti")
            .withColumn("_h", seeded_hash(seed, name)).withColumn("_bucket", F.substring("_h", 1, 3)))
    rest = running(rest, [], "_bucket", ["_h", session], {"_end": ("sum", F.col("size"), True)})
    spot = (F.col("_end") - F.col("size") / 2) * F.lit(sum(lacking)) / F.col("_end_total")
    chosen = (F.when(spot < lacking[0], "train").when(spot < lacking[0] + lacking[1], "val").otherwise("test"))
    placed = materialize(rest.select(session, chosen.alias("split")).unionByName(covering.select(session, "split")))
    return df.join(placed, session)


def _covering(table: DataFrame, sizes: DataFrame, label: str, session: str, classes: int) -> DataFrame:
    """(session, size, split): for each part, the sessions that bring every class into it."""
    reach = table.groupBy(label).agg(F.count(F.lit(1)).alias("_reach"))
    rarest = (table.join(reach, label).groupBy(session)
              .agg(F.min_by(label, F.struct("_reach", label)).alias("_rarest")))
    offers = materialize(table.join(rarest, session).join(sizes, session).select(
        session, label, "size", (F.col(label) != F.col("_rarest")).alias("_other")))
    taken = None
    for part in PARTS:
        free = offers if taken is None else offers.join(taken, session, "left_anti")
        best = free.groupBy(label).agg(F.min(F.struct("_other", -F.col("size"), session)).alias("_best"))
        best = materialize(best.select(label, F.col("_best")[session].alias(session)))
        if best.count() < classes:
            some = table.select(label).distinct().join(best, label, "left_anti").orderBy(label).limit(20).collect()
            raise ImpossibleSplit(f"no free session left to put classes {[r[label] for r in some]} into part {part}")
        own = best.select(session).distinct().withColumn("split", F.lit(part))
        taken = own if taken is None else taken.unionByName(own)
    return materialize(taken.join(sizes, session))


def split_session_hash(df: DataFrame, label: str = "label", session: str = "session_id",
                       train: float = 0.70, val: float = 0.15, test: float = 0.15,
                       seed: int = 42) -> DataFrame:
    """Session-disjoint split for any number of sessions: a pure function of the session name.

    Where a part lacks a class, sessions of that class move there by ``_repair_moves``; without such gaps no row is
    joined or shuffled.
    """
    table = session_table(df, label, session)
    _check_sessions(df, table, label, session)
    cut = [round(10_000 * train), round(10_000 * (train + val))]
    spot = F.conv(F.substring(seeded_hash(seed, F.col(session).cast("string")), 1, 8), 16, 10).cast("long") % 10_000
    part = F.when(spot < cut[0], "train").when(spot < cut[1], "val").otherwise("test")
    moves = _repair_moves(table.withColumn("split", part), label, session, seed)
    if moves is None:
        return df.withColumn("split", part)
    return df.join(moves, session, "left").withColumn("split", F.coalesce("_to", part)).drop("_to")


def _repair_moves(table: DataFrame, label: str, session: str, seed: int) -> DataFrame | None:
    """(session, _to): sessions that move so that each class is in each part; None if none has to.

    Rounds of offers and choices on the table of (session, class), over all sessions.  A session is free if it has not
    moved and its part keeps all its classes without it.  Each gap (class, part) asks for the first free session of its
    class in seeded hash order; a session asked by several gaps serves the first.  Of the sessions about to leave a
    part, at most all but one of each class go, first ones first; the others wait for the next round.  Each round fills
    a gap, so there are at most two a class; usually a few fill all.
    """
    order = F.struct(seeded_hash(seed, F.col(session).cast("string")).alias("h"), F.col(session).alias("s"))
    held = materialize(table.select(session, label, "split", F.lit(None).cast("string").alias("_to")))
    while True:
        gaps = materialize(held.groupBy(label).agg(F.collect_set("split").alias("_in")).select(
            label, F.explode(F.array_except(F.array(*map(F.lit, PARTS)), "_in")).alias("_gap")))
        if gaps.isEmpty():
            moved = held.filter("_to IS NOT NULL").select(session, "_to").distinct()
            return None if moved.isEmpty() else moved
        spare = held.groupBy(label, "split").agg((F.count(F.lit(1)) - 1).alias("_spare"))
        able = held.join(spare, [label, "split"])
        free = (able.groupBy(session).agg(F.min("_spare").alias("_least"), F.max("_to").alias("_moved"))
                .filter("_least > 0 AND _moved IS NULL").select(session))
        asked = (held.join(free, session, "left_semi").join(gaps, label).groupBy(label, "_gap")
                 .agg(F.min(order)["s"].alias(session)))
        place = F.array_position(F.array(*map(F.lit, PARTS)), F.col("_gap"))
        served = asked.groupBy(session).agg(F.min(F.struct(label, place.alias("_place"), "_gap"))["_gap"].alias("_new"))
        rank = F.row_number().over(Window.partitionBy(label, "split").orderBy(order))
        leaving = able.join(served, session).withColumn("_rank", rank)
        going = materialize(leaving.groupBy(session, "_new").agg(F.every(F.col("_rank") <= F.col("_spare")).alias("_fits"))
                            .filter("_fits").select(session, "_new"))
        if going.isEmpty():
            some = [f"{r[0]} into {r[1]}" for r in gaps.orderBy(label, "_gap").limit(20).collect()]
            raise ImpossibleSplit(f"no free session left to put classes {some}")
        held = materialize(held.join(going, session, "left").select(
            session, label, F.coalesce("_new", "split").alias("split"), F.coalesce("_new", "_to").alias("_to")))


def split_scenarios(df: DataFrame, test_scenarios: DataFrame, scenario: str = "scenario_id") -> DataFrame:
    """Test rows are those of the listed scenarios, train rows all others."""
    listed = test_scenarios.select(scenario).distinct().withColumn("_test", F.lit(True))
    return (df.join(listed, scenario, "left")
            .withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test"))


def split_time_holdout(df: DataFrame, start: str, session: str = "session_id", test: float = 0.2) -> DataFrame:
    """Later sessions form the test part: those that start after the (1 - test) quantile of starts."""
    from packetloom.operators.delay import quantiles
    starts = df.groupBy(session).agg(F.min(start).alias("_start"))
    cut = one_row(quantiles(starts, "_start", [], [1.0 - test]))
    late = starts.filter(F.col("_start") > cut["q0"]).select(session)
    late = late.withColumn("_late", F.lit(True))
    return (df.join(late, session, "left")
            .withColumn("split", F.when(F.col("_late"), "test").otherwise("train")).drop("_late"))


def split_samples(df: DataFrame, protocol: str, **options) -> DataFrame:
    """Split by protocol name."""
    protocols = {"paper_flow_random": split_stratified, "session_scenario_disjoint": split_session_disjoint,
                 "nested": split_nested, "session_hash": split_session_hash, "time_holdout": split_time_holdout}
    if protocol not in protocols:
        raise ValueError(f"unknown split protocol {protocol!r}; expected one of {sorted(protocols)}")
    return protocols[protocol](df, **options)


def shared_sessions(df: DataFrame, session: str = "session_id") -> DataFrame:
    """One row per session that is in two parts, for each such pair of parts."""
    seen = df.groupBy(session).agg(F.collect_set("split").alias("_in"))
    pairs = []
    for i, a in enumerate(PARTS):
        for b in PARTS[i + 1:]:
            both = F.array_contains("_in", a) & F.array_contains("_in", b)
            pairs.append(F.when(both, F.struct(F.lit(a).alias("part_a"), F.lit(b).alias("part_b"))))
    return (seen.filter(F.size("_in") > 1)
            .select(F.explode(F.array_compact(F.array(*pairs))).alias("_p"), session)
            .select("_p.part_a", "_p.part_b", session))


def leakage_report(df: DataFrame, session: str = "session_id") -> DataFrame:
    """Shared sessions per pair of parts, a leak flag and a note; all three pairs are listed."""
    spark = df.sparkSession
    pairs = spark.createDataFrame([("train", "val"), ("train", "test"), ("val", "test")],
                                  "part_a string, part_b string")
    counts = shared_sessions(df, session).groupBy("part_a", "part_b").agg(
        F.count(F.lit(1)).alias("shared_sessions"))
    out = pairs.join(counts, ["part_a", "part_b"], "left")
    n = F.coalesce("shared_sessions", F.lit(0))
    note = F.when(n > 0, F.lit("sessions appear on both sides")).otherwise(F.lit("no session in common"))
    return out.select("part_a", "part_b", n.alias("shared_sessions"), (n > 0).alias("leaks"), note.alias("note"))


def require_disjoint(df: DataFrame, session: str = "session_id") -> DataFrame:
    """``df`` again, after failing if any session is in two parts."""
    if shared_sessions(df, session).limit(1).count():
        raise AssertionError(f"a {session} is in two parts of the split")
    return df


def split_manifest(df: DataFrame, label: str = "label", session: str = "session_id") -> DataFrame:
    """Rows, sessions and class weight per part and class."""
    counts = df.groupBy("split", label).agg(F.count(F.lit(1)).alias("rows"))
    named = (df.select("split", label, session).distinct()
             .groupBy("split", label).agg(F.count(F.lit(1)).alias("sessions")))
    weights = class_weights(df.filter("split = 'train'"), label).select(label, "weight")
    return counts.join(named, ["split", label]).join(weights, label, "left")


def split_ids(df: DataFrame, idents: list[str]) -> DataFrame:
    """The ids of each part: (split, kind, id), each once; ``kind`` is the column of ``idents`` they come from."""
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("id")) for c in idents])
    return df.select("split", F.explode(kinds).alias("i")).select("split", "i.*").filter("id IS NOT NULL").distinct()


def split_digests(df: DataFrame, idents: list[str]) -> DataFrame:
    """One digest of the set of ids per part and kind, with its size: equal sets have equal digests in any order.

    Hashes of ids are counted and summed by their first three digits, before the shuffle and in one task per digits and
    part at most; the digest is that of the 4,096 sums.
    """
    hashed = F.md5("id")
    summed = (split_ids(df, idents).withColumn("prefix", F.substring(hashed, 1, 3))
              .groupBy("split", "kind", "prefix").agg(
                  F.count(F.lit(1)).alias("n"),
                  F.sum(F.conv(F.substring(hashed, 4, 15), 16, 10).cast("decimal(20,0)")).alias("total")))
    line = F.concat_ws(":", "prefix", F.col("n").cast("string"), F.col("total").cast("string"))
    return summed.groupBy("split", "kind").agg(
        F.sum("n").alias("ids"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("digest"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights N / (K * N_c); 1.0 when there is one class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total = one_row(counts.agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("k")))
    weight = F.when(total["k"] < 2, F.lit(1.0)).otherwise(total["n"] / (total["k"] * F.col("rows")))
    return counts.select(label, "rows", weight.alias("weight"))


def pos_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Negatives per positive; fails without positives, 1.0 without negatives."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    counts = df.agg(pos.alias("positives"), neg.alias("negatives"))
    none = F.raise_error(F.lit("no positive rows to weigh")).cast("double")
    weight = (F.when(F.col("positives") == 0, none).when(F.col("negatives") == 0, F.lit(1.0))
              .otherwise(F.col("negatives") / F.col("positives")))
    return counts.withColumn("pos_weight", weight)


def fit_scaler(train: DataFrame, features: str = "features") -> DataFrame:
    """Mean and deviation per feature over the real steps of training windows (one row per feature).

    Population variance with a floor of 1e-12.  Steps equal to the padding vector are left out.
    """
    steps = train.select(F.explode(features).alias("_s")).filter(F.col("_s") != vector_of(PADDING))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i in range(len(PADDING)):
        x = F.col("_s")[i]
        aggs += [F.avg(x).alias(f"_m{i}"), F.var_pop(x).alias(f"_v{i}")]
    wide = steps.agg(*aggs)
    empty = F.raise_error(F.lit("no training step to fit the scaler on")).cast("double")
    cells = [F.struct(F.lit(i).alias("feature"),
                      F.when(F.col("_n") == 0, empty).otherwise(F.col(f"_m{i}")).alias("mean"),
                      F.sqrt(F.greatest(F.lit(1e-12), F.col(f"_v{i}"))).alias("std"))
             for i in range(len(PADDING))]
    return wide.select(F.inline(F.array(*cells)))


def apply_scaler(df: DataFrame, scaler: DataFrame, features: str = "features") -> DataFrame:
    """Scale every real step with a fitted scaler; padding stays as it is."""
    fitted = scaler.agg(F.sort_array(F.collect_list(F.struct("feature", "mean", "std"))).alias("f"))
    pad, fit = vector_of(PADDING), one_row(fitted)["f"]  # five entries

    def scale(step: Column) -> Column:
        moved = F.zip_with(step, F.col("_f"), lambda x, f: (x - f["mean"]) / f["std"])
        return F.when(step == pad, step).otherwise(moved)

    return df.withColumn("_f", fit).withColumn(features, F.transform(features, scale)).drop("_f")
