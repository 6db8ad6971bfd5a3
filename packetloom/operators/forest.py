"""Trees and forests of which the driver holds only the tops.

Nodes grow with the rows; Spark ML keeps all of them on the driver and sends them to every task that scores.  Here rows
become blocks of bin numbers.  Nodes of more than ROWS_PER_NODE rows are split in passes over all blocks, one for each
level: tasks count (bin, class) per tree, node and feature, and only splits reach the driver.  What hangs below is grown in
one task for each (tree, node) and stays in a written table; scoring deals rows out to the same (tree, node).

The rules are those of Spark ML: up to BINS bins a feature from quantiles (NaN is in the last), weights drawn from a
Poisson distribution for each tree, some features drawn for each node, impurity cut while there is any gain, and sibling
leaves of one class merged (inside a task's part of a tree).  Random numbers are not Spark's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.ordered import materialize

BINS = 32
ROWS_PER_BLOCK = 1 << 16
ROWS_PER_NODE = 1 << 16  # weighted rows of a node that one task grows
ROWS_PER_ROUND = 40_000_000  # rows times trees that are dealt out at a time, which bounds the disk
NODES_PER_PASS = 20_000  # nodes a task counts for at a time
NODES_AT_ONCE = 2_000  # of those that arrays of gains are made for

NODE = np.dtype([("feature", "<i2"), ("cut", "u1"), ("left", "<i4"), ("gain", "<f8"), ("n", "<f8", 2)])
LEAF, OPEN, SPLIT = -1, -2, -3  # in place of a feature: ends here, is grown in a task, waits for the next pass


@dataclass(frozen=True)
class Rules:
    trees: int
    depth: int
    entropy: bool
    per_node: int | None  # features drawn for a node; None: all of them
    bootstrap: bool
    seed: int


def impurity(n: np.ndarray, entropy: bool) -> np.ndarray:
    share = n / np.maximum(n.sum(axis=-1, keepdims=True), 1e-300)
    if entropy:
        return -(share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=-1)
    return 1.0 - (share * share).sum(axis=-1)


def best_splits(counts: np.ndarray, drawn: np.ndarray, entropy: bool) -> tuple:
    """Gain, feature, bin and class counts to the left of each node's best split.

    ``counts`` are by node, drawn feature, bin and class.  A gain of 0 or less is no split.
    """
    left = counts.cumsum(axis=2)
    whole = left[:, :, -1:]
    left = left[:, :, :-1]
    right = whole - left
    n_left, n_right = left.sum(axis=-1), right.sum(axis=-1)
    n = np.maximum(n_left + n_right, 1e-300)
    gain = impurity(whole, entropy) - (n_left * impurity(left, entropy) + n_right * impurity(right, entropy)) / n
    gain[(n_left == 0) | (n_right == 0)] = -1.0
    gain = gain.reshape(len(counts), -1)
    best, row = gain.argmax(axis=1), np.arange(len(counts))
    j, cut = np.divmod(best, BINS - 1)
    return gain[row, best], drawn[row, j], cut.astype(np.uint8), left[row, j, cut]


def count(bins: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Weights by node, drawn feature, bin and class, of rows that are ``at`` a node."""
    nodes, m = drawn.shape
    rows, out = np.arange(len(at)), np.empty((nodes, m, BINS, 2))
    for j in range(m):
        cell = (at * BINS + bins[rows, drawn[at, j]]) * 2 + y
        out[:, j] = np.bincount(cell, w, nodes * BINS * 2).reshape(nodes, BINS, 2)
    return out


def draw(rng: np.random.Generator, nodes: int, features: int, per_node: int | None) -> np.ndarray:
    if per_node is None or per_node >= features:
        return np.tile(np.arange(features), (nodes, 1))
    return np.argsort(rng.random((nodes, features)), axis=1)[:, :per_node]


def children(level: np.ndarray, which: np.ndarray, base: int, splits: tuple) -> np.ndarray:
    """The two children of each of ``which`` nodes of ``level``, which learn their split; children start at ``base``."""
    gain, feature, cut, left = splits
    level["feature"][which], level["cut"][which], level["gain"][which] = feature, cut, gain
    level["left"][which] = base + 2 * np.arange(len(which))
    out = np.zeros(2 * len(which), NODE)
    out["feature"] = LEAF
    out["n"][0::2], out["n"][1::2] = left, level["n"][which] - left
    return out


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, rules: Rules, rng: np.random.Generator) -> np.ndarray:
    """The nodes below and with one that stands at ``depth``, breadth first."""
    level = np.zeros(1, NODE)
    level["feature"], level["n"][0] = LEAF, np.bincount(y, w, 2)
    out, base = [level], 0
    rows, at = np.arange(len(y)), np.zeros(len(y), np.int64)
    active = np.flatnonzero((level["n"] > 0).all(axis=1))
    while len(active) and depth < rules.depth:
        drawn = draw(rng, len(active), bins.shape[1], rules.per_node)
        found = []
        for a in range(0, len(active), NODES_AT_ONCE):  # rows are in the order of their nodes
            lo, hi = np.searchsorted(at, [a, a + NODES_AT_ONCE])
            own = rows[lo:hi]
            some = drawn[a:a + NODES_AT_ONCE]
            found.append(best_splits(count(bins[own], y[own], w[own], at[lo:hi] - a, some), some, rules.entropy))
        gain, feature, cut, left = (np.concatenate(x) for x in zip(*found))
        ok = gain > 0
        base, depth = base + len(level), depth + 1
        rank, feature, cut = np.cumsum(ok) - 1, feature[ok], cut[ok]
        level = children(level, active[ok], base, (gain[ok], feature, cut, left[ok]))
        out.append(level)
        rows, at = rows[ok[at]], rank[at[ok[at]]]
        to = 2 * at + (bins[rows, feature[at]] > cut[at])
        mixed = (level["n"] > 0).all(axis=1)
        active, rank = np.flatnonzero(mixed), np.cumsum(mixed) - 1
        rows, at = rows[mixed[to]], rank[to[mixed[to]]]
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
    return np.concatenate(out)


def prune(nodes: np.ndarray) -> np.ndarray:
    """Siblings that are leaves of one class become one leaf, from below."""
    one = nodes["n"][:, 1] > nodes["n"][:, 0]
    while True:
        inner = np.flatnonzero(nodes["feature"] >= 0)
        left = nodes["left"][inner]
        same = (nodes["feature"][left] == LEAF) & (nodes["feature"][left + 1] == LEAF) & (one[left] == one[left + 1])
        if not same.any():
            return nodes
        nodes["feature"][inner[same]] = LEAF


def gains(nodes: np.ndarray, features: int) -> np.ndarray:
    inner = nodes[nodes["feature"] >= 0]
    return np.bincount(inner["feature"], inner["gain"] * inner["n"].sum(axis=1), features).astype(float)


def walk(nodes: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The node where each row ends."""
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(rows):
        here = at[rows]
        inner = nodes["feature"][here] >= 0
        rows, here = rows[inner], here[inner]
        at[rows] = nodes["left"][here] + (bins[rows, nodes["feature"][here]] > nodes["cut"][here])
    return at


def share(n: np.ndarray) -> np.ndarray:
    return n[:, 1] / np.maximum(n.sum(axis=1), 1e-300)


def thresholds(df: DataFrame, names: Sequence[str]) -> list[np.ndarray]:
    """Upper ends of all bins but the last, per feature."""
    steps = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    values = [F.col(f"`{c}`").cast("double") for c in names]
    row = df.agg(*[F.percentile_approx(F.when(~F.isnan(v), v), steps, F.lit(10_000)).alias(f"q{i}")
                   for i, v in enumerate(values)]).first()
    return [np.unique(np.array(q or [], float)) for q in row]


def blocks(df: DataFrame, names: Sequence[str], edges: list[np.ndarray], extra: str, kind: str) -> DataFrame:
    """A written table of ROWS_PER_BLOCK rows in a row: bin numbers, and the ``extra`` column."""
    def pack(parts: list[pd.DataFrame], number: int) -> pd.DataFrame:
        part = pd.concat(parts)
        bins = np.empty((len(part), len(edges)), np.uint8)
        for j, edge in enumerate(edges):
            bins[:, j] = np.searchsorted(edge, part[f"f{j}"].to_numpy(float), side="left")
        return pd.DataFrame({"block": [TaskContext.get().partitionId() << 32 | number], "size": [len(part)],
                             "bins": [bins.tobytes()], "extra": [part["extra"].to_numpy(kind).tobytes()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, number = [], 0, 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= ROWS_PER_BLOCK:
                yield pack(held, number)
                held, size, number = [], 0, number + 1
        if size:
            yield pack(held, number)
    columns = [F.col(f"`{c}`").cast("double").alias(f"f{j}") for j, c in enumerate(names)]
    return materialize(df.select(F.col(f"`{extra}`").cast("long").alias("extra"), *columns)
                       .mapInPandas(run, "block long, size int, bins binary, extra binary"))


def _read(block, features: int) -> np.ndarray:
    return np.frombuffer(block.bins, np.uint8).reshape(block.size, features)


def _weights(rules: Rules, tree: int, block) -> np.ndarray:
    """Weights of a block's rows in a tree: the same in every pass."""
    if not rules.bootstrap:
        return np.ones(block.size)
    return np.random.default_rng([rules.seed % (1 << 63), tree, block.block]).poisson(1.0, block.size).astype(float)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator:
    for batch in batches:
        yield from batch.itertuples(index=False)


def _pass(table: DataFrame, tops: dict[int, np.ndarray], drawn: dict[int, np.ndarray], features: int, rules: Rules) -> list:
    """(tree, whole, splits) of the nodes that wait in some trees."""
    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for block in _rows(batches):
            bins, y = _read(block, features), np.frombuffer(block.extra, np.uint8)
            for tree, some in drawn.items():
                waits = tops[tree]["feature"] == SPLIT
                at, w = walk(tops[tree], bins), _weights(rules, tree, block)
                rows = np.flatnonzero(waits[at] & (w > 0))
                counts = count(bins[rows], y[rows], w[rows], (np.cumsum(waits) - 1)[at[rows]], some)
                sums[tree] = sums[tree] + counts if tree in sums else counts
        for tree, counts in sums.items():
            yield pd.DataFrame({"tree": [tree], "counts": [counts.tobytes()]})

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        some = drawn[tree]
        counts = sum(np.frombuffer(c).reshape(*some.shape, BINS, 2) for c in rows["counts"])
        parts = [best_splits(counts[a:a + NODES_AT_ONCE], some[a:a + NODES_AT_ONCE], rules.entropy)
                 for a in range(0, len(counts), NODES_AT_ONCE)]
        gain, feature, cut, left = (np.concatenate(x) for x in zip(*parts))
        return pd.DataFrame({"tree": [tree], "whole": [counts[:, 0].sum(axis=1).tobytes()], "gain": [gain.tobytes()],
                             "feature": [feature.tobytes()], "cut": [cut.tobytes()], "left": [left.tobytes()]})
    return (table.mapInPandas(tally, "tree int, counts binary").groupBy("tree")
            .applyInPandas(split, "tree int, whole binary, gain binary, feature binary, cut binary, left binary").collect())


def _tops(table: DataFrame, n: int, features: int, rules: Rules) -> list[np.ndarray]:
    """Of each tree the nodes above ROWS_PER_NODE rows and their children."""
    root = np.zeros(1, NODE)
    root["feature"] = SPLIT if n > ROWS_PER_NODE and rules.depth > 0 else OPEN
    tops, rng = [root.copy() for _ in range(rules.trees)], np.random.default_rng([rules.seed % (1 << 63), rules.trees])
    for depth in range(rules.depth):
        waiting = {t: int((top["feature"] == SPLIT).sum()) for t, top in enumerate(tops)}
        trees = [t for t, k in waiting.items() if k]
        if not trees:
            break
        drawn = {t: draw(rng, waiting[t], features, rules.per_node) for t in trees}
        while trees:
            fits = max(1, int((np.cumsum([waiting[t] for t in trees]) <= NODES_PER_PASS).sum()))
            now, trees = trees[:fits], trees[fits:]
            for r in _pass(table, {t: tops[t] for t in now}, {t: drawn[t] for t in now}, features, rules):
                top = tops[r.tree]
                which = np.flatnonzero(top["feature"] == SPLIT)
                top["n"][which], top["feature"][which] = np.frombuffer(r.whole).reshape(-1, 2), LEAF
                gain = np.frombuffer(r.gain)
                ok = gain > 0
                found = (gain[ok], np.frombuffer(r.feature, np.int64)[ok], np.frombuffer(r.cut, np.uint8)[ok],
                         np.frombuffer(r.left).reshape(-1, 2)[ok])
                below = children(top, which[ok], len(top), found)
                mixed = (below["n"] > 0).all(axis=1) & (depth + 1 < rules.depth)
                below["feature"][mixed] = np.where(below["n"][mixed].sum(axis=1) > ROWS_PER_NODE, SPLIT, OPEN)
                tops[r.tree] = np.concatenate([top, below])
    return tops


def _depths(nodes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(nodes), np.int64)
    for i in np.flatnonzero(nodes["feature"] >= 0):  # children come after their parent
        out[nodes["left"][i]:nodes["left"][i] + 2] = out[i] + 1
    return out


def _dealt(tops: dict[int, np.ndarray], features: int, rules: Rules | None):
    """Rows of blocks by (tree, open node); with ``rules`` those of positive weight, and their weights."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _rows(batches):
            bins = _read(block, features)
            y = np.frombuffer(block.extra, np.uint8) if rules else None
            for tree, top in tops.items():
                at = walk(top, bins)
                picked = top["feature"][at] == OPEN
                w = _weights(rules, tree, block) if rules else None
                rows = np.flatnonzero(picked & (w > 0) if rules else picked)
                rows = rows[np.argsort(at[rows], kind="stable")]
                heads = np.flatnonzero(np.r_[True, at[rows][1:] != at[rows][:-1]][:len(rows)])
                parts = [rows[a:b] for a, b in zip(heads, np.r_[heads[1:], len(rows)])]
                out = {"tree": tree, "node": at[rows[heads]], "bins": [bins[p].tobytes() for p in parts]}
                if rules:
                    out |= {"y": [y[p].tobytes() for p in parts], "w": [w[p].astype(np.uint8).tobytes() for p in parts]}
                else:
                    out |= {"block": block.block, "size": block.size,
                            "rows": [p.astype(np.uint32).tobytes() for p in parts]}
                yield pd.DataFrame(out)
    return run


def _rounds(trees: int, rows: int) -> list[range]:
    step = max(1, ROWS_PER_ROUND // max(1, rows))
    return [range(a, min(a + step, trees)) for a in range(0, trees, step)]


SUBTREE = "tree int, node int, nodes binary, gains array<double>, n_nodes long"


@dataclass
class Forest:
    """A fitted forest of two classes: tops on the driver, what is below them in the written table ``subtrees``."""
    names: list[str]
    edges: list[np.ndarray]
    tops: list[np.ndarray]
    subtrees: DataFrame
    rules: Rules

    @classmethod
    def fit(cls, train: DataFrame, names: Sequence[str], label: str, rules: Rules) -> Forest:
        """``label`` is 0 or 1 in every row."""
        names, edges = list(names), thresholds(train, names)
        table = blocks(train, names, edges, label, "uint8")
        n, features = table.agg(F.sum("size").alias("n")).first().n or 0, len(names)
        tops = _tops(table, n, features, rules)

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            tree, node = int(rows["tree"].iloc[0]), int(rows["node"].iloc[0])
            bins = np.frombuffer(b"".join(rows["bins"]), np.uint8).reshape(-1, features)
            y, w = (np.frombuffer(b"".join(rows[c]), np.uint8) for c in ("y", "w"))
            rng = np.random.default_rng([rules.seed % (1 << 63), tree, node, 1])
            nodes = prune(grow(bins, y.astype(np.int64), w.astype(float), depths[tree][node], rules, rng))
            return pd.DataFrame({"tree": [tree], "node": [node], "nodes": [nodes.tobytes()],
                                 "gains": [gains(nodes, features)], "n_nodes": [len(nodes)]})
        parts = []
        for some in _rounds(rules.trees, n):
            depths = {t: _depths(tops[t]) for t in some}
            dealt = table.mapInPandas(_dealt({t: tops[t] for t in some}, features, rules),
                                      "tree int, node int, bins binary, y binary, w binary")
            parts.append(materialize(dealt.groupBy("tree", "node").applyInPandas(run, SUBTREE)))
        return cls(names, edges, tops, reduce(DataFrame.unionByName, parts), rules)

    def importances(self) -> np.ndarray:
        """Gains times rows by feature; each tree's sum to 1, and so do those of the forest."""
        features = len(self.names)
        sums = self.subtrees.groupBy("tree").agg(F.array(*[F.sum(F.col("gains")[i]) for i in range(features)]).alias("g"))
        by_tree = np.array([gains(top, features) for top in self.tops])
        for r in sums.collect():
            by_tree[r.tree] += r.g
        by_tree /= np.maximum(by_tree.sum(axis=1, keepdims=True), 1e-300)
        whole = by_tree.sum(axis=0)
        return whole / max(whole.sum(), 1e-300)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` and ``probability`` of both classes."""
        features, tops, key = len(self.names), self.tops, "_forest_row"
        rows = materialize(df.withColumn(key, F.monotonically_increasing_id()))
        table = blocks(rows, self.names, self.edges, key, "int64")
        n = table.agg(F.sum("size").alias("n")).first().n or 0

        def score(rows: pd.DataFrame, subtree: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(subtree):  # a tree whose weights are all 0 has no subtree and votes for class 0
                return pd.DataFrame(columns=["block", "size", "rows", "p"])
            nodes = np.frombuffer(subtree["nodes"].iloc[0], NODE)
            p = share(nodes["n"])
            own = [p[walk(nodes, np.frombuffer(b, np.uint8).reshape(-1, features))].tobytes() for b in rows["bins"]]
            return rows[["block", "size", "rows"]].assign(p=own)

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            size = int(rows["size"].iloc[0])
            at, p = np.frombuffer(b"".join(rows["rows"]), np.uint32), np.frombuffer(b"".join(rows["p"]))
            return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "p": [np.bincount(at, p, size).tobytes()]})

        def finish(block: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
            block = next(block.itertuples(index=False))
            p, bins = np.zeros(block.size), _read(block, features)
            for part in sums["p"]:
                p += np.frombuffer(part)
            for top in tops:  # rows that end above all subtrees
                at = walk(top, bins)
                p += np.where(top["feature"][at] == LEAF, share(top["n"])[at], 0.0)
            return pd.DataFrame({key: np.frombuffer(block.extra, np.int64), "_p": p / len(tops)})
        parts = []
        for some in _rounds(len(tops), n):
            dealt = table.mapInPandas(_dealt({t: tops[t] for t in some}, features, None),
                                      "tree int, node int, bins binary, block long, size int, rows binary")
            own = self.subtrees.filter(F.col("tree").between(some[0], some[-1]))
            scored = dealt.groupBy("tree", "node").cogroup(own.groupBy("tree", "node")).applyInPandas(
                score, "block long, size int, rows binary, p binary")
            parts.append(materialize(scored.groupBy("block").applyInPandas(add, "block long, p binary")))
        sums = reduce(DataFrame.unionByName, parts)
        found = table.groupBy("block").cogroup(sums.groupBy("block")).applyInPandas(finish, f"{key} long, _p double")
        return (rows.join(found, key).withColumn("prediction", F.when(F.col("_p") > 0.5, 1.0).otherwise(0.0))
                .withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop(key, "_p"))


def rules_for(name: str, features: int, seed: int, settings: dict) -> Rules | None:
    """The rules of a classifier of Spark ML by its settings; None where they go beyond what is done here."""
    known = {"random_forest": {"numTrees", "impurity", "maxDepth", "seed", "cacheNodeIds"},
             "decision_tree": {"impurity", "maxDepth", "seed"}}
    if name not in known or set(settings) - known[name] or settings.get("impurity") not in ("gini", "entropy"):
        return None
    trees = settings["numTrees"] if name == "random_forest" else 1
    return Rules(trees, settings["maxDepth"], settings["impurity"] == "entropy",
                 math.ceil(math.sqrt(features)) if trees > 1 else None, name == "random_forest", settings.get("seed", seed))
