"""One query per corpus operator, over whole tables, with SQL twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import (
    bpe, collocations, decontaminate, exact_dedup, fingerprints, jaccard_join, language_model, manifest, mixing, pii,
    quality, secrets, suffix_dedup)
from packetloom.llm.tables import documents

QUERIES, ORACLE = {}, {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return add


@query(r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         length(coalesce(text, '')) AS chars,
         length(regexp_replace(coalesce(text, ''), '[!-/:-@\[-`{-~]', '', 'g')) AS plain,
         (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':mix-1'), 1, 12) AS BIGINT) + 0.5::DOUBLE)
           / 281474976710656::DOUBLE AS u
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         -ln(u) / CASE WHEN chars = 0 THEN 1 ELSE greatest(0.05::DOUBLE, 1 - (4 * (chars - plain))::DOUBLE / chars) END
           AS key
  FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM keyed GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM sources
  WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, place
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap, weight * coalesce(
           (SELECT arg_min(level, [cap / weight, place]) FROM levels WHERE cap / weight > level), 1e300)) AS target
  FROM levels),
reached AS (
  SELECT doc_id, k.source, size, source_size, target,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS words
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN target > epochs * source_size
                                   AND words - size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END)
            AS BIGINT) AS taken
FROM reached""")
def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(documents(spark, sf)).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op6_bpe(spark: SparkSession, sf: str) -> DataFrame:
    encoded = bpe.encode(documents(spark, sf), RANKS, PATTERN)
    return bpe.decode(encoded, RANKS, PATTERN).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query(r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256, n AS n_chars
FROM t
WINDOW best AS (PARTITION BY norm ORDER BY n DESC, doc_id)""")
def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.equal_texts(documents(spark, sf))


@query()
def op8_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.similar_documents(documents(spark, sf))


@query()
def op5_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs, ledger = documents(spark, sf), secrets.new_ledger(spark)
    secrets.scan(docs, ledger)
    base = [r.name for r in secrets.BASE]
    marks = F.transform("spans", lambda s: F.concat_ws(
        ":", F.substring_index(s["rule"], "@", 1), s["start"], s["end"]))
    own = F.transform(F.filter("spans", lambda s: s["rule"].isin(base)), lambda s: F.concat_ws(
        ":", F.substring_index(s["rule"], "@", 1), s["start"], s["end"]))

    def count(rule):
        return F.size(F.filter("spans", lambda s: s["rule"] == rule.name)).cast("long").alias(f"n_{rule.kind}")
    return secrets.findings(docs, ledger).select(
        "doc_id", *[count(r) for r in secrets.BASE], F.sha2(F.array_join(own, ","), 256).alias("base_sha256"),
        F.array_join(marks, ",").alias("spans"))


@query()
def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query()
def op2_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.compare(documents(spark, sf))


@query()
def op9_pii(spark: SparkSession, sf: str) -> DataFrame:
    def marks(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return pii.spans(documents(spark, sf)).select(
        "doc_id", *[count(k) for k in pii.KINDS], F.sha2(marks("base"), 256).alias("base_sha256"),
        marks("all_spans").alias("spans"))


@query()
def op4_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.without_repeats(documents(spark, sf)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op3_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return language_model.score(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query(r"""
WITH RECURSIVE ids AS (
  SELECT *, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
              string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
            lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
              lambda x, step: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)) AS crc
  FROM documents),
fields AS (
  SELECT doc_id, lang, n_chars, xor(crc, 4294967295::UBIGINT) % 7 = 0 AS tampered,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
           || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM ids),
leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place,
         count(*) OVER (PARTITION BY lang) AS n,
         sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN tampered AND n_chars IS NOT NULL
              THEN sha256(head || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS bent
  FROM fields),
tree(level, lang, place, n, digest) AS (
  SELECT 0, lang, place, n, leaf FROM leaves
  UNION ALL
  SELECT level + 1, lang, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place))
  FROM tree WHERE n > 1 GROUP BY level, lang, place // 2, n),
subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM tree WHERE n = 1),
top(level, place, n, digest) AS (
  SELECT 0, place, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place))
  FROM top WHERE n > 1 GROUP BY level, place // 2, n),
walk(doc_id, lang, top_place, level, place, n, node, proof, up) AS (
  SELECT doc_id, l.lang, s.place, 0, l.place, l.n, coalesce(bent, leaf), '', false
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT w.doc_id, w.lang, w.top_place,
         CASE WHEN w.n = 1 AND NOT w.up THEN 0 ELSE w.level + 1 END,
         CASE WHEN w.n = 1 AND NOT w.up THEN w.top_place ELSE w.place // 2 END,
         CASE WHEN w.n = 1 AND NOT w.up THEN (SELECT count(*) FROM subroots) ELSE (w.n + 1) // 2 END,
         CASE WHEN w.n = 1 AND NOT w.up THEN w.node
              WHEN w.place % 2 = 1 THEN sha256(coalesce(t.digest, u.digest, '') || w.node)
              ELSE sha256(w.node || coalesce(t.digest, u.digest, '')) END,
         CASE WHEN w.n = 1 AND NOT w.up THEN w.proof ELSE w.proof || coalesce(t.digest, u.digest, '') END,
         w.up OR w.n = 1
  FROM walk w
  LEFT JOIN tree t ON NOT w.up AND w.n > 1 AND t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level
                  AND t.place = xor(w.place, 1)
  LEFT JOIN top u ON w.up AND u.level = w.level AND u.place = xor(w.place, 1)
  WHERE NOT w.up OR w.n > 1)
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root,
       w.node = r.digest AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
JOIN walk w ON w.doc_id = l.doc_id AND w.up AND w.n = 1
JOIN top r ON r.n = 1""")
def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    fields = [F.col(f) for f in manifest.FIELDS]
    fields[manifest.FIELDS.index("n_chars")] = F.col("n_chars").cast("decimal(20,0)") + 1
    bent = F.when(tampered & F.col("n_chars").isNotNull(), manifest.leaf_digest(fields))
    rows = manifest.proofs(manifest.build(docs, keep=[bent.alias("bent")]))
    return (rows.withColumn("folded_root", manifest.fold(F.coalesce("bent", "leaf"), F.col("path")))
            .select(F.col("id").alias("doc_id"), "leaf", "subroot", "root",
                    F.sha2(manifest.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


@query(r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
asked AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[p:p + least(len(words), 10) - 1], ' ') AS phrase
  FROM b, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS u(p) WHERE len(words) > 0),
runs AS (
  SELECT doc_id, s.size, p, array_to_string(words[p:p + s.size - 1], ' ') AS phrase
  FROM d, (SELECT DISTINCT size FROM asked) AS s, unnest(range(1, len(words) - s.size + 2)) AS u(p)),
found AS (
  SELECT doc_id, p, r.size, item_id FROM runs r JOIN asked a ON r.size = a.size AND r.phrase = a.phrase),
hit AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit FROM found, unnest(range(p, p + size)) AS u(w) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op12_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    shards = decontaminate.index(documents(spark, sf), F.col("doc_id"))
    return decontaminate.contamination(shards, spark.read.parquet(f"{sf}/benchmark.parquet")).select(
        F.col("key").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query(r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
counts AS (
  SELECT lang, words[p:p + k - 1] AS phrase, k, count(*) AS f
  FROM split, unnest(range(1, len(words) + 1)) AS u(p), unnest(range(1, 5)) AS v(k)
  WHERE p + k - 1 <= len(words) GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, s AS cut, l.f AS l, r.f AS r, 2000000::HUGEINT * c.f // (l.f + r.f) AS score
  FROM candidates c, unnest(range(1, c.k)) AS u(s)
  JOIN counts l ON l.lang = c.lang AND l.phrase = c.phrase[1:s]
  JOIN counts r ON r.lang = c.lang AND r.phrase = c.phrase[s + 1:]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, phrase[p:p + k2 - 1] AS phrase, f
  FROM candidates c, unnest(range(1, k)) AS u(p), unnest(range(2, k)) AS v(k2) WHERE p + k2 - 1 <= k
  UNION ALL SELECT lang, phrase[2:], f FROM candidates WHERE k > 2),
covered AS (
  SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN inner_parts i ON c.lang = i.lang AND c.phrase = i.phrase
  WHERE 100::HUGEINT * i.f >= 80::HUGEINT * c.f)
SELECT lang, rank, array_to_string(phrase, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank
      FROM lowest ANTI JOIN covered USING (lang, phrase)) JOIN sizes USING (lang)
WHERE rank <= 2000""")
def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf), top=2000).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
