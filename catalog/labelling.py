"""Path rules, labels, quotas, samples and audits."""

from pyspark.sql import functions as F

from catalog.registry import Registry
from catalog.sequence import event_clumps, flow_packets
from catalog.tables import CLUMPS_SQL, FLOWS_SQL, PACKETS_SQL, event_packets, load
from packetloom.functions import names as N
from packetloom.functions import paths as P
from packetloom.functions.endpoints import touches_resolver
from packetloom.functions.tls import tls_application_bytes
from packetloom.operators import flows as L
from packetloom.operators import labels as A
from packetloom.operators import windows as W
from packetloom.schema import FLOW

REGISTRY = Registry()
query = REGISTRY.query

# Page urls as capture paths: a folder and a tool name depend on the page, the rest is the url.
FOLDERS = ["BenignDoH_NonDoH-Firefox", "MaliciousDoH/iodine", "NonDoH/chrome", "misc/Video-non_doh", "doh/quad9",
           "captures", "Benign/adguard", "x\\\\ndoh", "tunnel/dns2tcp"]
URL_PATH = "regexp_replace(url, '^https?://', '')"


def page_paths(spark, sf):
    pages = load(spark, sf, "pages")
    folder = F.element_at(F.array(*[F.lit(f.replace("\\\\", "\\")) for f in FOLDERS]),
                          (F.col("page_id") % len(FOLDERS) + 1).cast("int"))
    tail = F.regexp_replace("url", "^https?://", "")
    return pages.select("page_id", F.concat_ws("/", folder, tail).alias("path"))


PATHS_SQL = f"""paths AS (
  SELECT page_id, list_extract([{', '.join("'" + f.replace(chr(92) * 2, chr(92)) + "'" for f in FOLDERS)}],
         CAST(page_id % {len(FOLDERS)} + 1 AS INTEGER)) || '/' || {URL_PATH} AS path FROM pages),
lowered AS (SELECT page_id, path, lower(replace(path, '\\', '/')) AS t FROM paths)"""


def sql_has(words, t="t"):
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


def sql_first(words, default, t="t"):
    return "CASE " + " ".join(f"WHEN contains({t}, '{w}') THEN '{w}'" for w in words) + f" ELSE '{default}' END"


# DuckDB has no lookbehind: drop "benigndoh" first, then look for "ndoh".
SQL_NDOH = "contains(replace(t, 'benigndoh', ''), 'ndoh')"
SQL_NON = f"({sql_has(P.NON_DOH_WORDS)} OR {SQL_NDOH})"


@query(f"""WITH {PATHS_SQL}
SELECT page_id,
  CASE WHEN {sql_has(P.MALICIOUS_WORDS)} THEN 'malicious_doh' WHEN contains(t, 'benign') THEN 'benign_doh'
       WHEN {SQL_NON} THEN 'non_doh' WHEN contains(t, 'doh') THEN 'benign_doh' ELSE 'non_doh' END AS category,
  CASE WHEN {sql_has(P.MALICIOUS_WORDS)} THEN 'malicious_doh_' || {sql_first(P.TOOLS, 'tunnel')}
       WHEN contains(t, 'benign') THEN 'benign_doh_' || {sql_first(P.BENIGN_CLIENTS, 'browsing')}
       WHEN {SQL_NON} THEN 'non_doh_' || {sql_first(P.NON_DOH_APPS, 'browsing')}
       WHEN contains(t, 'doh') THEN 'benign_doh_' || {sql_first(P.BENIGN_CLIENTS, 'browsing')}
       ELSE 'non_doh_unknown' END AS scenario_id,
  {sql_has(P.MALICIOUS_WORDS)} AS is_malicious
FROM lowered""")
def path_metadata(spark, sf):
    out = page_paths(spark, sf).withColumn("m", P.path_metadata(F.col("path")))
    return out.select("page_id", "m.*")


@query(f"""WITH {PATHS_SQL}, low AS (SELECT page_id, lower(path) AS t FROM paths)
SELECT page_id,
  CASE WHEN {sql_has(P.MALICIOUS_WORDS)} THEN 'malicious_doh_' || {sql_first(['dns2tcp', 'dnscat2'], 'iodine')}
       WHEN {sql_has(P.NON_DOH_WORDS + ['ndoh'])} THEN 'non_doh_' || {sql_first(P.NON_DOH_APPS, 'browsing')}
       WHEN {sql_has(['benign', 'doh'])} THEN 'benign_doh_' || {sql_first(['firefox', 'chrome'], 'general')}
       ELSE 'non_doh_browsing' END AS scenario_id FROM low""")
def runner_path_metadata(spark, sf):
    out = page_paths(spark, sf).withColumn("m", P.runner_path_metadata(F.col("path")))
    return out.select("page_id", "m.scenario_id")


SQL_STEM = r"regexp_replace({x}, '([^.])\.[^.]*$', '\1')"


@query(f"""WITH {PATHS_SQL}, parts AS (
  SELECT page_id, regexp_extract(replace(path, '\\', '/'), '([^/]*)$', 1) AS base,
         regexp_extract(replace(path, '\\', '/'), '([^/]+)/+[^/]*$', 1) AS parent FROM paths),
stems AS (SELECT page_id, parent, {SQL_STEM.format(x='base')} AS stem FROM parts),
bare AS (SELECT page_id, parent, CASE WHEN suffix(stem, '.pcap') OR suffix(stem, '.pcapng') OR suffix(stem, '.cap')
                THEN {SQL_STEM.format(x='stem')} ELSE stem END AS stem FROM stems),
clean AS (SELECT page_id, regexp_replace(stem, '[^a-zA-Z0-9_-]', '_', 'g') AS stem, parent FROM bare)
SELECT page_id, CASE WHEN length(stem) < 6 AND parent NOT IN ('', '.')
       THEN regexp_replace(parent, '[^a-zA-Z0-9_-]', '_', 'g') || '_' || stem ELSE stem END AS session_id FROM clean""")
def session_ids(spark, sf):
    return page_paths(spark, sf).select("page_id", P.session_id(F.col("path")).alias("session_id"))


# Documents as TLS segments: each 16,000 bytes of text in a record of its own, the last one with the rest.
@query("""WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n, doc_id % 5 AS kind, lang FROM documents)
SELECT doc_id, CAST(CASE WHEN kind < 3 AND n >= 40 THEN n END AS BIGINT) AS app_bytes FROM d""")
def tls_app_bytes(spark, sf):
    docs = load(spark, sf, "documents")
    body, step = F.hex(F.encode("text", "utf-8")), 16_000
    kind = F.when(F.col("doc_id") % 5 < 3, "170303").when(F.col("doc_id") % 5 == 3, "160301").otherwise("170403")
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("text") - 1, F.lit(0)), F.lit(step))
    rows = docs.select("doc_id", body.alias("body"), kind.alias("kind"), starts.alias("starts"))

    def record(start):
        part = F.substring("body", 2 * start + 1, F.lit(2 * step))
        return F.concat("kind", F.lpad(F.hex(F.length(part) / 2), 4, "0"), part)
    segment = F.unhex(F.array_join(F.transform("starts", record), ""))
    return rows.select("doc_id", tls_application_bytes(segment).alias("app_bytes"))


RESOLVERS_SQL = """flow_rows AS (
  SELECT source_id, key, flow_no, CASE CAST(key AS BIGINT) % 4 WHEN 0 THEN '8.8.8.8' WHEN 1 THEN '9.9.9.11'
         ELSE '10.0.0.1' END AS server, CASE CAST(key AS BIGINT) % 3 WHEN 0 THEN 'malicious_doh'
         WHEN 1 THEN 'benign_doh' ELSE 'non_doh' END AS category, min(packet_no) AS first_no, count(*) AS n
  FROM flow_packets GROUP BY 1, 2, 3),
labelled AS (
  SELECT *, CASE WHEN server <> '10.0.0.1' THEN 1 ELSE 0 END AS l1_label,
         CASE WHEN server <> '10.0.0.1' THEN CASE category WHEN 'malicious_doh' THEN 1 WHEN 'benign_doh' THEN 0 END END
           AS l2_label FROM flow_rows),
classed AS (
  SELECT *, CASE WHEN l1_label = 0 THEN 'non_doh' WHEN l2_label = 1 THEN 'malicious_doh' ELSE 'benign_doh' END AS class
  FROM labelled)"""


def labelled_flows(spark, sf):
    """Flows of ``events``; the user decides the server address, and its capture the category."""
    user = F.col("key").cast("long")
    flows = flow_packets(spark, sf).groupBy(*FLOW).agg(F.min("packet_no").alias("first_no"), F.count(F.lit(1)).alias("n"))
    server = F.when(user % 4 == 0, "8.8.8.8").when(user % 4 == 1, "9.9.9.11").otherwise("10.0.0.1")
    flows = flows.withColumns({"client": F.lit("10.1.0.1"), "server": server, "scenario_id": F.lit("other"),
                               "source_id": F.concat(F.lit("u"), F.col("key"))})
    flows = flows.withColumn("is_doh", touches_resolver("client", "server"))
    users = event_packets(spark, sf).select("key").distinct()
    category = (F.when(user % 3 == 0, "malicious_doh").when(user % 3 == 1, "benign_doh").otherwise("non_doh"))
    captures = users.select(F.concat(F.lit("u"), F.col("key")).alias("source_id"), category.alias("category"),
                            (category == "malicious_doh").alias("is_malicious"))
    return A.label_flows(flows, captures)


@query(f"WITH {FLOWS_SQL}, {RESOLVERS_SQL} SELECT key, flow_no, l1_label, l2_label, class FROM classed")
def flow_labels(spark, sf):
    return labelled_flows(spark, sf).select("key", "flow_no", "l1_label", "l2_label", A.flow_class().alias("class"))


def quota_sql(where, cls):
    return f"""WITH {FLOWS_SQL}, {RESOLVERS_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {cls} ORDER BY first_no) AS r FROM classed {where})
SELECT key, flow_no, class FROM ranked WHERE r <= 200"""


@query(quota_sql("", "class"))
def class_quota(spark, sf):
    kept = A.cap_flows_per_class(labelled_flows(spark, sf), 200, ["first_no"])
    return kept.select("key", "flow_no", A.flow_class().alias("class"))


@query(quota_sql("", "CASE WHEN class = 'non_doh' THEN class ELSE 'doh' END"))
def class_quota_l1(spark, sf):
    kept = A.cap_flows_per_class(labelled_flows(spark, sf), 200, ["first_no"], "l1")
    return kept.select("key", "flow_no", A.flow_class().alias("class"))


@query(quota_sql("WHERE class <> 'non_doh'", "class"))
def class_quota_l2(spark, sf):
    kept = A.cap_flows_per_class(labelled_flows(spark, sf), 200, ["first_no"], "l2")
    return kept.select("key", "flow_no", A.flow_class().alias("class"))


@query(f"""WITH {FLOWS_SQL}, {RESOLVERS_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY first_no) AS r FROM classed)
SELECT key, flow_no FROM ranked WHERE r <= 5""")
def capture_cap(spark, sf):
    return A.cap_flows_per_capture(labelled_flows(spark, sf), 5, ["first_no"]).select("key", "flow_no")


# Flows in reading order, one row at a time: what is kept, and how full classes and captures are by then.
BOTH_QUOTAS_SQL = f"""WITH RECURSIVE {FLOWS_SQL}, {RESOLVERS_SQL},
line AS (SELECT CAST(key AS BIGINT) % 40 AS capture, key, flow_no, class,
                row_number() OVER (ORDER BY CAST(key AS BIGINT) % 40, first_no) AS place FROM classed),
step AS (SELECT 0::BIGINT AS place, -1::BIGINT AS capture, NULL::VARCHAR AS key, NULL::BIGINT AS flow_no, false AS kept,
                0::BIGINT AS held, 0::BIGINT AS n0, 0::BIGINT AS n1, 0::BIGINT AS n2
         UNION ALL
         SELECT place, capture, key, flow_no, kept, held + kept::INT, n0 + (kept AND class = 'non_doh')::INT,
                n1 + (kept AND class = 'benign_doh')::INT, n2 + (kept AND class = 'malicious_doh')::INT
         FROM (SELECT l.place, l.capture, l.key, l.flow_no, l.class, s.n0, s.n1, s.n2,
                      CASE WHEN l.capture = s.capture THEN s.held ELSE 0 END AS held,
                      (CASE WHEN l.capture = s.capture THEN s.held ELSE 0 END) < 30 AND
                      CASE l.class WHEN 'non_doh' THEN s.n0 WHEN 'benign_doh' THEN s.n1 ELSE s.n2 END < 120 AS kept
               FROM step s JOIN line l ON l.place = s.place + 1))
SELECT key, flow_no FROM step WHERE kept"""


@query(BOTH_QUOTAS_SQL)
def both_quotas(spark, sf):
    flows = labelled_flows(spark, sf).withColumn("source_id", F.col("key").cast("long") % 40)
    return A.cap_flows(flows, 30, 120, ["source_id", "first_no"]).select("key", "flow_no")


def windows_with_labels(spark, sf):
    out = W.scaled_windows(event_clumps(spark, sf), 3)
    return out.withColumn("label", (F.col("key").cast("long") % 4 == 0).cast("int"))


@query(f"""WITH {CLUMPS_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY key, flow_no) AS n FROM clumps),
wins AS (SELECT key, flow_no, clump_no AS window_index, CASE WHEN CAST(key AS BIGINT) % 4 = 0 THEN 1 ELSE 0 END AS label
         FROM sized WHERE clump_no + 3 <= n OR (n < 3 AND clump_no = 0)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CAST(key AS BIGINT), flow_no, window_index) AS r FROM wins)
SELECT key, flow_no, window_index, label FROM ranked WHERE r <= 700""")
def window_class_cap(spark, sf):
    rows = windows_with_labels(spark, sf).withColumn("user", F.col("key").cast("long"))
    kept = A.cap_windows_per_class(rows, 700, ["user", "flow_no", "window_index"])
    return kept.select("key", "flow_no", "window_index", "label")


@query(f"""WITH {CLUMPS_SQL}, sizes AS (SELECT key, flow_no, count(*) AS n FROM clumps GROUP BY 1, 2),
per AS (SELECT CASE WHEN CAST(key AS BIGINT) % 4 = 0 THEN 1 ELSE 0 END AS label,
               CAST(sum(greatest(n - 2, 1)) AS BIGINT) AS offered FROM sizes GROUP BY 1)
SELECT label, offered, least(offered, 700) AS kept, offered - least(offered, 700) AS dropped FROM per""")
def window_cap_overflow(spark, sf):
    rows = windows_with_labels(spark, sf)
    kept = A.cap_windows_per_class(rows, 700, ["key", "flow_no", "window_index"])
    return A.cap_overflow(rows.select("label"), kept)


@query(f"""WITH {CLUMPS_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY source_id, key, flow_no) AS n FROM clumps),
ends AS (SELECT source_id, key, flow_no, arg_min(ts_us, packet_no) AS start_us, max(ts_us) AS end_us FROM flow_packets GROUP BY 1, 2, 3)
SELECT source_id || '|' || key || '|' || flow_no || '_w' || clump_no AS sample_id, 's' || key AS session_id,
  CASE WHEN CAST(key AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS label,
  CASE WHEN CAST(key AS BIGINT) % 3 = 0 THEN 'malicious_doh' ELSE 'benign_doh' END AS label_name, 2 AS layer, 3 AS window_size,
  n < 3 AS is_padded, CAST(greatest(3 - n, 0) AS INTEGER) AS pad_count, e.start_us, e.end_us,
  repeat('1', CAST(least(n, 3) AS INTEGER)) || repeat('0', CAST(greatest(3 - n, 0) AS INTEGER)) AS mask
FROM sized JOIN ends e USING (source_id, key, flow_no)
WHERE CAST(key AS BIGINT) % 4 = 0 AND CAST(key AS BIGINT) % 3 < 2 AND (clump_no + 3 <= n OR (n < 3 AND clump_no = 0))""")
def sequence_samples(spark, sf):
    user = F.col("key").cast("long")
    flows = L.summarise_flows(flow_packets(spark, sf)).withColumns({
        "flow_id": L.flow_id(), "session_id": F.concat(F.lit("s"), F.col("key")), "scenario_id": F.lit("any"),
        "source_file": F.col("source_id"), "l1_label": (user % 4 == 0).cast("int"),
        "l2_label": F.when(user % 4 == 0, F.when(user % 3 == 0, 1).when(user % 3 == 1, 0))})
    out = W.sequence_samples(W.scaled_windows(event_clumps(spark, sf), 3), flows, layer=2, window_size=3)
    mask = F.array_join(F.transform("mask", lambda m: m.cast("int").cast("string")), "")
    return out.select("sample_id", "session_id", "label", "label_name", "layer", "window_size", "is_padded", "pad_count",
                      "start_us", "end_us", mask.alias("mask"))


@query("""WITH ranked AS (
  SELECT doc_id, quality, row_number() OVER (PARTITION BY quality
         ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) AS r FROM labels)
SELECT doc_id, quality FROM ranked WHERE r <= 100""")
def per_class_sample(spark, sf):
    return A.sample_per_class(load(spark, sf, "labels"), "quality", "doc_id", 100).select("doc_id", "quality")


@query(f"""WITH {PACKETS_SQL}, marked AS (
  SELECT *, length >= 1000 AS accepted, length + 66 AS frame_bytes FROM packets)
SELECT count(*) AS raw_packets, CAST(sum(frame_bytes) AS BIGINT) AS raw_bytes, count(*) FILTER (accepted) AS accepted_packets,
  CAST(sum(length) FILTER (accepted) AS BIGINT) AS accepted_bytes,
  (WITH {FLOWS_SQL}, {RESOLVERS_SQL} SELECT count(*) FROM classed) AS flows_seen,
  (WITH {FLOWS_SQL}, {RESOLVERS_SQL} SELECT count(*) FROM classed WHERE n > 4) AS flows_truncated,
  (WITH {FLOWS_SQL}, {RESOLVERS_SQL} SELECT count(*) FROM classed WHERE n > 2) AS flows_kept,
  (WITH {FLOWS_SQL}, {RESOLVERS_SQL} SELECT count(*) FROM classed WHERE n > 2 AND class = 'non_doh') AS kept_non_doh,
  (WITH {FLOWS_SQL}, {RESOLVERS_SQL} SELECT count(*) FROM classed WHERE n > 2 AND class = 'benign_doh') AS kept_benign_doh,
  (WITH {FLOWS_SQL}, {RESOLVERS_SQL} SELECT count(*) FROM classed WHERE n > 2 AND class = 'malicious_doh') AS kept_malicious_doh,
  false AS quotas_satisfied
FROM marked""")
def ingest_counters(spark, sf):
    raw = event_packets(spark, sf).withColumns({"accepted": F.col("length") >= 1000, "frame_bytes": F.col("length") + 66})
    flows = labelled_flows(spark, sf).withColumn("truncated", F.col("n") > 4)
    return A.ingest_counters(raw, flows, flows.filter("n > 2"), quota=10**6)


CAPTURES_SQL = f"""WITH {PATHS_SQL}, caps AS (
  SELECT CASE WHEN {sql_has(P.MALICIOUS_WORDS)} THEN 'malicious_doh' WHEN contains(t, 'benign') THEN 'benign_doh'
              WHEN {SQL_NON} THEN 'non_doh' WHEN contains(t, 'doh') THEN 'benign_doh' ELSE 'non_doh' END AS category,
         'f' || CAST(page_id % 9 AS VARCHAR) AS scenario_id, 's' || CAST(page_id % 25 AS VARCHAR) AS session_id,
         length(html) AS size_bytes FROM lowered JOIN pages USING (page_id))"""


@query(f"""{CAPTURES_SQL}
SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(scenario_id) = 0 THEN 'scenario'
            WHEN grouping(session_id) = 0 THEN 'session' ELSE 'total' END AS level,
       coalesce(category, scenario_id, session_id) AS value, count(*) AS captures,
       CAST(sum(size_bytes) AS BIGINT) AS total_bytes,
       grouping(category) = 1 AND grouping(scenario_id) = 1 AND grouping(session_id) = 1 AND count(*) >= 100 AS capped
FROM caps GROUP BY GROUPING SETS ((category), (scenario_id), (session_id), ())""")
def capture_audit(spark, sf):
    paths = page_paths(spark, sf).withColumn("m", P.path_metadata(F.col("path")))
    sizes = load(spark, sf, "pages").select("page_id", F.length("html").alias("size_bytes"))
    captures = paths.join(sizes, "page_id").select(
        "m.category", F.concat(F.lit("f"), (F.col("page_id") % 9).cast("string")).alias("scenario_id"),
        F.concat(F.lit("s"), (F.col("page_id") % 25).cast("string")).alias("session_id"), "size_bytes")
    return A.audit_captures(captures, max_members=100)


@query("""WITH v AS (SELECT nullif(trim(lang), 'fr') AS value FROM documents),
c AS (SELECT value, count(*) AS rows FROM v GROUP BY 1)
SELECT value, rows, (SELECT count(*) FROM v) AS total_rows, (SELECT count(*) FROM v WHERE value IS NULL) AS null_rows,
       (SELECT count(DISTINCT value) FROM v) AS distinct_values
FROM c WHERE value IS NOT NULL ORDER BY rows DESC, value LIMIT 20""")
def label_audit(spark, sf):
    docs = load(spark, sf, "documents").select(F.expr("nullif(trim(lang), 'fr')").alias("lang"))
    return A.audit_label_column(docs, "lang", top=20)


NAMES = ["Benign-DoH", " nondoh", "Malicious", "iodine", "Non-DoH", "chrome", "what", "browsing", "DOH-Tunnel"]
NAME_SQL = f"list_extract([{', '.join(repr(n) for n in NAMES)}], CAST(event_id % {len(NAMES)} + 1 AS INTEGER))"


def named_events(spark, sf):
    pick = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("event_id") % len(NAMES) + 1).cast("int"))
    return load(spark, sf, "events").select("event_id", pick.alias("name"))


def target_sql(task):
    low = "lower(trim(name))"
    names = N.label_names(task)
    quote = lambda xs: ", ".join(f"'{x}'" for x in xs)
    case = " ".join(f"WHEN {low} IN ({quote(xs)}) THEN {i}" for i, xs in enumerate(names.values()))
    drop = f"WHERE {low} NOT IN ({quote(N.L1_NAMES['non_doh'])})" if task == "l2" else ""
    return f"""WITH n AS (SELECT event_id, {NAME_SQL} AS name FROM events)
SELECT event_id, name, CASE {case} END AS target FROM n {drop}"""


@query(target_sql("l1"))
def label_map_l1(spark, sf):
    return A.map_labels(named_events(spark, sf), "name", "l1")


@query(target_sql("l2"))
def label_map_l2(spark, sf):
    return A.map_labels(named_events(spark, sf), "name", "l2")


@query(f"""WITH t AS ({target_sql("l1")})
SELECT lower(trim(name)) AS label, count(*) AS rows FROM t WHERE target IS NULL GROUP BY 1""")
def unknown_labels(spark, sf):
    return A.unknown_labels(named_events(spark, sf), "name", "l1")
