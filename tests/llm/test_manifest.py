import random
import zlib

import pytest
from pyspark.sql import functions as F

from packetloom.llm import manifest, queries
import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def leaf(row):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    return brute.sha("".join(field(row[k]) for k in (0, 3, 2, 4, 1)))


def climb(nodes):
    """Root of the nodes and, per node, the siblings up to it as (left, digest)."""
    paths, spots, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for path, i in zip(paths, spots):
            path.append((i % 2 == 1, level[i ^ 1] if i ^ 1 < len(level) else ""))
        spots, level = [i // 2 for i in spots], [brute.sha("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
    return level[0], paths


def expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    grouped = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
               for x in langs}
    trees = {x: climb([leaf(r) for r in own]) for x, own in grouped.items()}
    root, upper = climb([trees[x][0] for x in langs])
    out = []
    for lang, up in zip(langs, upper):
        for r, path in zip(grouped[lang], trees[lang][1]):
            bent = list(r)
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                bent[4] += 1
            node = leaf(bent)
            for left, other in path + up:
                node = brute.sha(other + node if left else node + other)
            out.append((r[0], leaf(r), trees[lang][0], root, brute.sha("".join(d for _, d in path + up)), node,
                        node == root))
    return sorted(out, key=repr)


def table(spark, rows):
    clash = ["name", "block", "place", "digest", "kept", "one", "id", "top", "levels", "path", "root", "of", "leaf"]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in clash})


def run(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, queries.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


def random_rows(n):
    rng = random.Random(n)
    rows = [(rng.randrange(n), rng.choice(["a b", "é漢🙂", "", None, "x" * 5000]), rng.choice(["en", "de", "zh", None, "="]),
             rng.choice([None, "s1", "s2"]), rng.choice([None, 7, 123])) for _ in range(n)]
    rows += rows[:n // 10] + [(None, "t", "en", "s", 1), (None, None, None, None, None), (-5, "neg", "only", "s", 4)]
    return rows


@pytest.mark.parametrize("n", [1, 5, 130])
def test_manifest_equals_plain_tree(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(manifest, "LEVELS", 2)
    monkeypatch.setattr(manifest, "BLOCK", 4)
    rows = random_rows(n)
    assert run(spark, rows, tmp_path) == expected(rows)


def test_manifest_with_full_blocks(spark, tmp_path):
    rows = [(i, f"text {i}", "en" if i % 3 else "de", "s", i) for i in range(900)]
    assert run(spark, rows, tmp_path) == expected(rows)


def test_manifest_of_one_row_and_of_none(spark, tmp_path):
    one = [(7, "alone", None, None, 5)]
    assert run(spark, one, tmp_path / "one") == expected(one)
    assert run(spark, [], tmp_path / "none") == []


def test_any_changed_field_breaks_the_proof(spark):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(20)]
    found = manifest.proofs(manifest.build(table(spark, rows), keep=[F.col("text")]))
    honest = found.select((manifest.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"))
    forged = found.select((manifest.fold(F.sha2("text", 256), F.col("path")) == F.col("root")).alias("ok"))
    assert {r.ok for r in honest.collect()} == {True}
    assert {r.ok for r in forged.collect()} == {False}
