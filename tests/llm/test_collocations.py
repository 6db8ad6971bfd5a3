import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packetloom.llm import collocations

CLASH = ["window", "phrase", "words", "n", "edge", "key", "range", "part", "best", "score", "rank", "a", "l", "r"]


def pieces(text):
    folded = (text or "").translate({65 + i: 97 + i for i in range(26)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", folded)]


def expected(rows, least, covered):
    count, size = Counter(), Counter()
    for text, lang in rows:
        for words in pieces(text):
            size[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    count[lang or "und", tuple(words[i:i + k])] += 1
    good = {p: a for p, a in count.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in good.items():
        longer = [f for (g, q), f in good.items() if g == lang and len(q) > len(p)
                  and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if not any(100 * f >= covered * a for f in longer):
            cuts = [(2_000_000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, " ".join(p), a, count[lang, p[:k]], count[lang, p[k:]], size[lang], score))
    return sorted(out)


def fixture():
    rng = random.Random(8)
    fixed = ["new york city hall", "as far as i", "a a a a a", "\x01x y", "é 漢字 🙂"]
    rows = []
    for i in range(120):
        words = [rng.choice(fixed) if rng.random() < 0.3 else f"w{int(rng.random() ** 3 * 30)}" for _ in range(rng.randrange(30))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "! "]) for w in words)
        rows.append((text.upper() if i % 9 == 0 else text, rng.choice(["en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "en"), (" .,;\n", "zz")] + rows[:5]


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string").repartition(3).withColumns(
        {c: F.lit("clash") for c in CLASH})


@pytest.mark.parametrize("per_batch", [10_000, 7])
def test_collocations_equal_plain_counts(spark, monkeypatch, per_batch):
    rows = fixture()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
    try:
        got = collocations.collocations(table(spark, rows), least=5).select(
            "lang", "phrase", "a", "l", "r", "n", "score").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got)) == expected(rows, 5, 80)


def test_windows_do_not_depend_on_batches(spark):
    docs = table(spark, fixture())
    whole, parts = [sorted(map(tuple, collocations.window_counts(docs, words).groupBy("lang", "window").agg(
        F.sum("n")).collect())) for words in (1 << 20, 20)]
    assert whole == parts and len(whole) > 500


def test_top_is_ranked_by_score_count_and_phrase(spark):
    docs = table(spark, fixture())
    every = [tuple(r) for r in collocations.collocations(docs, least=5).select("lang", "score", "a", "phrase").collect()]
    top = collocations.collocations(docs, least=5, top=4).select("lang", "rank", "score", "a", "phrase").collect()
    for lang in {r[0] for r in every}:
        want = sorted((-s, -a, p.encode(), p) for g, s, a, p in every if g == lang)[:4]
        assert [(-r.score, -r.a, r.phrase) for r in sorted(top, key=lambda r: r["rank"]) if r.lang == lang] == [
            (s, a, p) for s, a, _, p in want]


def test_products_beyond_64_bits_are_exact(spark):
    big = 9 * 10 ** 18
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 3)],
                                   "lang string, phrase string, words int, n long")
    row = collocations.scored(counts).first()
    assert row.score == 2_000_000 * (big - 3) // (2 * big - 1)


def test_no_words(spark):
    assert collocations.collocations(table(spark, [(None, None), ("..", "en")]), top=5).count() == 0
    assert collocations.collocations(table(spark, fixture()).limit(0)).count() == 0
