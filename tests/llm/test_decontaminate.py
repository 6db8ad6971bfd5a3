import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import decontaminate
from packetloom.llm.fm_index import FmIndex

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CLASH = ["row", "rows", "spans", "items", "key", "phrase", "item", "block", "zero", "size", "words", "start", "end"]


def words_of(text):
    return re.findall(WORD, (text or "").translate({65 + i: 97 + i for i in range(26)}))


def expected(docs, items):
    asked = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            asked.setdefault(tuple(w[i:i + 10]), set()).add(item)
    sizes, out = {len(p) for p in asked}, []
    for key, text in docs:
        w, hit, named = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in asked:
                    hit |= set(range(i, i + n))
                    named |= {str(x) for x in asked[tuple(w[i:i + n])] if x is not None}
        out.append((None if key is None else str(key), len(w), len(hit), sorted(named)))
    return sorted(out, key=repr)


def tables(spark, docs, items):
    def frame(rows, key):
        return spark.createDataFrame(rows, f"{key} long, text string").repartition(2).withColumns(
            {c: F.lit("clash") for c in CLASH})
    return frame(docs, "doc_id"), frame(items, "item_id")


def fixture():
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(n))) for i, n in enumerate([3, 9, 10, 11, 25, 40, 1])]
    items += [(4, items[5][1]), (None, "loose item of no id"), (20, None), (21, "?! .."), (22, items[4][1].upper())]
    docs = [(0, None), (1, ""), (2, "..."), (3, items[4][1]), (3, items[4][1]), (None, "x " + items[5][1]),
            (5, "É漢字 " + items[2][1].title() + "é"), (6, items[0][1] + ", " + items[0][1]), (7, "loose, item OF-no id.")]
    docs += [(10 + i, " ".join(f"w{int(rng.random() ** 2 * 60)}" for _ in range(rng.randrange(400)))) for i in range(20)]
    docs.append((50, " ".join(w for _, t in items * 40 if t for w in [t, f"w{rng.randrange(60)}"])))
    return docs, items


@pytest.mark.parametrize("shard_words, block_phrases", [(1 << 20, 1 << 16), (50, 7)])
def test_contamination_equals_plain_search(spark, shard_words, block_phrases):
    docs, items = fixture()
    table, benchmark = tables(spark, docs, items)
    shards = decontaminate.index(table, F.col("doc_id"), shard_words=shard_words)
    got = decontaminate.contamination(shards, benchmark, block_phrases=block_phrases)
    assert sorted([(r.key, r.n_words, r.n_hit, r["items"]) for r in got.collect()], key=repr) == expected(docs, items)
    assert all(r.n_hit == sum(s.end - s.start for s in r.spans) and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
               for r in got.collect())


def test_empty_tables(spark):
    docs, items = tables(spark, [(1, "a b")], [(1, "a b")])
    none = decontaminate.contamination(decontaminate.index(docs, F.col("doc_id")), items.limit(0)).collect()
    assert [(r.key, r.n_words, r.n_hit, r.spans, r["items"]) for r in none] == [("1", 2, 0, [], [])]
    assert decontaminate.contamination(decontaminate.index(docs.limit(0), F.col("doc_id")), items).count() == 0


def test_covered_words_leave_the_text(spark):
    passage = "one two three, four five six seven eight nine TEN eleven"
    docs, items = tables(spark, [(1, f"Before. {passage}! After"), (None, f"Before. {passage}! After"), (2, "clean é"),
                                 (3, None)], [(1, passage)])
    got = decontaminate.without_benchmark(docs, items)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(
        [(1, "Before. ! After"), (None, "Before. ! After"), (2, "clean é"), (3, None)], key=repr)


@pytest.mark.parametrize("seed", range(30))
def test_index_finds_every_occurrence(seed):
    rng = np.random.default_rng(seed)
    kinds = int(rng.integers(1, 5))
    pieces = [rng.integers(1, kinds + 1, rng.integers(0, 200)).astype(np.int32) for _ in range(rng.integers(1, 6))]
    built = FmIndex.build(pieces, kinds)
    fm, text = FmIndex.unpack(built.size, **built.pack()), np.concatenate([np.r_[p, 0] for p in pieces])
    phrases, lengths = rng.integers(0, kinds + 1, (40, 6)), rng.integers(1, 7, 40)
    places = {}
    for phrase, place in fm.occurrences(*fm.find(phrases, lengths)):
        for p, at in zip(phrase, place):
            places.setdefault(int(p), []).append(int(at))
    for i, (phrase, n) in enumerate(zip(phrases, lengths)):
        want = [j for j in range(len(text) - n + 1) if (text[j:j + n] == phrase[:n]).all() and (phrase[:n] > 0).all()]
        assert sorted(places.get(i, [])) == want
