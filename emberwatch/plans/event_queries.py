"""Labels, scores, seeds, signatures and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.functions.columns import col, entropy, index_day, iso
from emberwatch.operators import dashboard as D
from emberwatch.operators import labels as L
from emberwatch.operators import rarity as R
from emberwatch.operators import scoring as S
from emberwatch.plans.registry import query
from emberwatch.plans.twins import EVENTS, FLAGGED, LABELS, SCORES, SEEDS, cases, with_
from emberwatch.sources.tables import load, unified_events

EV = with_(EVENTS)
LAB = with_(EVENTS, LABELS)
SCO = with_(EVENTS, SCORES)
SEE = with_(EVENTS, SCORES, SEEDS)


@query("threat_score_by_host", SCO + """
SELECT host, severity, count(*) AS events, CAST(sum(score) AS BIGINT) AS total_score, CAST(max(score) AS INTEGER) AS max_score,
       count(*) FILTER (WHERE is_threat) AS threats
FROM scored GROUP BY host, severity""")
def threat_score_by_host(spark, folder):
    scored = S.with_threat(unified_events(spark, folder))
    return scored.groupBy(col("host.name").alias("host"), "severity").agg(
        F.count(F.lit(1)).alias("events"), F.sum("score").cast("bigint").alias("total_score"),
        F.max("score").alias("max_score"), F.count_if("is_threat").alias("threats"))


@query("threat_scores", SCO + "SELECT seq, score, is_threat, severity, reasons FROM scored")
def threat_scores(spark, folder):
    return S.with_threat(unified_events(spark, folder)).select(
        "seq", "score", "is_threat", "severity", F.array_join("reasons", "|").alias("reasons"))


@query("heuristic_scores", SCO + """
SELECT heur AS heuristic_score, count(*) AS events FROM scored GROUP BY heur""")
def heuristic_scores(spark, folder):
    return unified_events(spark, folder).groupBy(S.heuristics()["score"].alias("heuristic_score")).agg(
        F.count(F.lit(1)).alias("events"))


@query("seed_events", SEE + "SELECT seq, score, det_severity AS severity, confidence, tactic FROM seed")
def seed_events(spark, folder):
    return S.seeds(unified_events(spark, folder)).select(
        "seq", "score", col("detection.severity").alias("severity"),
        col("threat.confidence").alias("confidence"), col("threat.tactic.name").alias("tactic"))


@query("threats_with_tactic", SCO + f"""
SELECT COALESCE(tactic, {__import__('emberwatch.plans.twins', fromlist=['x']).TACTIC}) AS tactic, count(*) AS events
FROM scored WHERE score >= 50 OR dataset = 'cowrie' GROUP BY 1""")
def threats_with_tactic(spark, folder):
    """Tactic backfill over the whole table: seeds without the scan window."""
    return S.seeds(unified_events(spark, folder)).groupBy(col("threat.tactic.name").alias("tactic")).agg(
        F.count(F.lit(1)).alias("events"))


@query("critical_alert", EV + """
SELECT seq, eid AS event_id FROM ev WHERE det_severity = 'critical' OR reported IN (8, 10) ORDER BY ts DESC, seq DESC LIMIT 1""")
def critical_alert(spark, folder):
    return S.critical_alert(unified_events(spark, folder)).select("seq", col("event.id").alias("event_id"))


@query("best_seed", SEE + "SELECT seq, confidence FROM seed ORDER BY confidence DESC, ts DESC, seq DESC LIMIT 1")
def best_seed(spark, folder):
    return S.best_seed(S.seeds(unified_events(spark, folder))).select("seq", col("threat.confidence").alias("confidence"))


@query("event_labels", LAB + "SELECT seq, label FROM lab")
def event_labels(spark, folder):
    return L.with_labels(unified_events(spark, folder)).select("seq", "label")


@query("label_details", LAB + f"""
SELECT label, category, count(*) AS events FROM lab GROUP BY label, category""")
def label_details(spark, folder):
    return unified_events(spark, folder).withColumn("d", L.label_detail()).groupBy(
        F.col("d.label").alias("label"), col("event.category").alias("category")).agg(F.count(F.lit(1)).alias("events"))


@query("all_labels", EV + f"""
SELECT labels, count(*) AS events FROM (
  SELECT COALESCE(NULLIF(array_to_string([x FOR x IN [
      {cases('exe', L.EXECUTABLE_LABELS)}, {cases('path', L.FILE_LABELS)}, {cases('cmd', L.COMMAND_LABELS)},
      {cases('proto', L.PROTOCOL_LABELS)},
      CASE direction WHEN 'inbound' THEN 'NETWORK_Inbound' WHEN 'outbound' THEN 'NETWORK_Outbound'
        ELSE CASE WHEN proc IN ('curl', 'wget', 'fetch') THEN 'NETWORK_Outbound' END END] IF x IS NOT NULL], '|'), ''), 'UNKNOWN') AS labels
  FROM ev) GROUP BY labels""")
def all_labels(spark, folder):
    return unified_events(spark, folder).groupBy(F.array_join(L.all_labels(), "|").alias("labels")).agg(
        F.count(F.lit(1)).alias("events"))


@query("short_labels", EV + """
SELECT label, count(*) AS events FROM (
  SELECT CASE WHEN category = 'memory' AND a1_type <> 'WEIRD' THEN
      CASE a1_type WHEN 'MEMFD_EXEC' THEN 'FILELESS_ATTACK' WHEN 'ANON_ELF' THEN 'FILELESS_ATTACK'
        WHEN 'RWX_REGION' THEN 'CODE_INJECTION' ELSE 'PROCESS_HOLLOWING' END
    WHEN a2_type IS NOT NULL THEN 'CODE_INJECTION'
    WHEN contains(cmd, 'curl') AND contains(cmd, '|') AND contains(cmd, 'bash') THEN 'DOWNLOAD_AND_EXECUTE'
    ELSE upper(category) END AS label FROM ev) GROUP BY label""")
def short_labels(spark, folder):
    return unified_events(spark, folder).groupBy(L.short_label().alias("label")).agg(F.count(F.lit(1)).alias("events"))


@query("path_signatures", LAB + """
SELECT case_id, array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE label <> 'UNKNOWN')), ' -> ') AS signature
FROM lab GROUP BY case_id""")
def path_signatures(spark, folder):
    return L.path_signature(L.with_labels(unified_events(spark, folder)), ["case_id"])


@query("chain_fingerprints", LAB + """
, firsts AS (SELECT case_id, label, min(seq) AS o FROM lab GROUP BY case_id, label)
SELECT case_id, count(*) AS steps, sha256(string_agg(label, '->' ORDER BY o)) AS fingerprint FROM firsts GROUP BY case_id""")
def chain_fingerprints(spark, folder):
    seqs = L.label_sequence(L.with_labels(unified_events(spark, folder)), ["case_id"])
    return seqs.select("case_id", F.size("sequence").cast("bigint").alias("steps"), L.fingerprint(F.col("sequence")).alias("fingerprint"))


@query("rarity_scores", LAB + """
, lines AS (SELECT host, label, min(seq) AS s, count(*) AS n FROM lab GROUP BY host, label),
base AS (SELECT label AS signature, count(*) AS c FROM lab WHERE ts < TIMESTAMP '2024-01-20' GROUP BY label),
tot AS (SELECT sum(c) AS t FROM base)
SELECT host, lines.label AS signature, round(-log2(COALESCE(c, 1) / (SELECT t FROM tot)), 3) AS surprisal
FROM lines LEFT JOIN base ON base.signature = lines.label""".replace("base AS", "hist AS").replace("FROM base", "FROM hist").replace("JOIN base ON base.", "JOIN hist ON hist."))
def rarity_scores(spark, folder):
    """Surprisal of each host's labels against the first nineteen days."""
    lab = L.with_labels(unified_events(spark, folder)).withColumn("signature", F.col("label"))
    base = R.signature_baseline(lab.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp")))
    seen = lab.select(col("host.name").alias("host"), "signature").distinct()
    return R.surprisal(seen, base).select("host", "signature", F.round("surprisal", 3).alias("surprisal"))


@query("triple_rarity", EV + """
, tri AS (SELECT host, COALESCE(proc, 'process') AS subject, action AS operation,
                 COALESCE(path, dst_ip, 'none') AS object FROM ev),
freq AS (SELECT subject, operation, object, count(*) AS n FROM tri GROUP BY ALL),
tot AS (SELECT sum(n) AS t FROM freq)
SELECT host, count(*) AS edges, round(sum(-log2(n / (SELECT t FROM tot))), 2) AS path_score
FROM tri JOIN freq USING (subject, operation, object) GROUP BY host""")
def triple_rarity(spark, folder):
    ev = unified_events(spark, folder)
    tri = ev.select(
        col("host.name").alias("host"), F.coalesce(col("process.name"), F.lit("process")).alias("subject"),
        col("event.action").alias("operation"),
        F.coalesce(col("file.path"), col("destination.ip"), F.lit("none")).alias("object"))
    out = R.path_scores(tri, R.triple_baseline(tri), ["host"])
    return out.select("host", "edges", F.round("path_score", 2).alias("path_score"))


@query("attack_stages", EV + """
, ord AS (SELECT * FROM (VALUES ('Reconnaissance',0),('Resource Development',1),('Initial Access',2),('Execution',3),('Persistence',4),
  ('Privilege Escalation',5),('Defense Evasion',6),('Credential Access',7),('Discovery',8),('Lateral Movement',9),('Collection',10),
  ('Command and Control',11),('Exfiltration',12),('Impact',13)) t(tactic, o))
SELECT case_id, o AS stage, tactic, count(*) AS events, min(iso_ts) AS started, max(iso_ts) AS ended, tactic || ': ' || count(*) || ' events' AS description
FROM ev JOIN ord USING (tactic) GROUP BY case_id, o, tactic""")
def attack_stages(spark, folder):
    return R.attack_stages(unified_events(spark, folder), ["case_id"]).select(
        "case_id", "stage", "tactic", "events", iso(F.col("started")).alias("started"), iso(F.col("ended")).alias("ended"), "description")


@query("attacker_profiles", EV + """
SELECT src_ip AS attacker, count(*) AS events, count(DISTINCT host) AS hosts, count(DISTINCT technique) AS techniques,
  count(DISTINCT proc) AS tools, count(DISTINCT tactic) AS chain_depth, CAST(max(reported) AS INTEGER) AS max_severity
FROM ev GROUP BY src_ip""")
def attacker_profiles(spark, folder):
    return R.attacker_profile(unified_events(spark, folder))


@query("dashboard_totals", EV + f"SELECT count(*) AS total_events, count(*) FILTER (WHERE {FLAGGED}) AS threat_count FROM ev")
def dashboard_totals(spark, folder):
    return D.totals(unified_events(spark, folder))


@query("severity_distribution", EV + """
SELECT CASE WHEN det_severity IN ('high', 'medium', 'low') THEN det_severity ELSE 'unknown' END AS severity, count(*) AS events,
  CAST(floor(count(*) * 100.0 / (SELECT count(*) FROM ev) + 0.5) AS BIGINT) AS percent
FROM ev GROUP BY 1""")
def severity_distribution(spark, folder):
    return D.severity_distribution(unified_events(spark, folder))


@query("tactic_distribution", EV + "SELECT COALESCE(tactic, 'unknown') AS tactic, count(*) AS events FROM ev GROUP BY 1")
def tactic_distribution(spark, folder):
    return D.tactic_distribution(unified_events(spark, folder))


@query("top_tactics", EV + """
SELECT COALESCE(tactic, 'unknown') AS tactic, count(*) AS events FROM ev GROUP BY 1 ORDER BY events DESC, tactic LIMIT 6""")
def top_tactics(spark, folder):
    return D.tactic_distribution(unified_events(spark, folder), top=6)


_TREND = """
, b AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM ev {where} GROUP BY 1),
spine AS (SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), INTERVAL 1 HOUR)) AS bucket)
SELECT strftime(bucket, '%Y-%m-%d %H:%M') AS bucket, COALESCE(n, 0) AS events FROM spine LEFT JOIN b USING (bucket)"""


@query("event_trend", EV + _TREND.format(where=""))
def event_trend(spark, folder):
    return D.trend(unified_events(spark, folder)).select(F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), "events")


@query("threat_trend", EV + _TREND.format(where=f"WHERE {FLAGGED}"))
def threat_trend(spark, folder):
    return D.trend(unified_events(spark, folder), threats_only=True).select(
        F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), "events")


@query("attack_list", SEE + """
SELECT seq, eid AS event_id, host, src_ip AS source_ip, det_severity AS severity FROM seed ORDER BY ts DESC, seq DESC LIMIT 20""")
def attack_list(spark, folder):
    return D.attack_list(S.seeds(unified_events(spark, folder)), 20).select(
        "seq", col("event.id").alias("event_id"), col("host.name").alias("host"), col("source.ip").alias("source_ip"),
        col("detection.severity").alias("severity"))


@query("threat_ranking", SEE + """
SELECT seq, round(confidence * 100 + CASE det_severity WHEN 'high' THEN 1 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 ELSE 0.2 END * 40, 2) AS rank_score
FROM seed""")
def threat_ranking(spark, folder):
    return D.threat_ranking(S.seeds(unified_events(spark, folder))).select("seq", F.round("rank_score", 2).alias("rank_score"))


@query("high_risk_projection", SEE + f"""
SELECT CAST(floor((SELECT count(*) FILTER (WHERE det_severity = 'high') / count(*) FROM seed)
  * (SELECT count(*) FROM ev WHERE {FLAGGED}) + 0.5) AS BIGINT) AS high_risk""")
def high_risk_projection(spark, folder):
    ev = unified_events(spark, folder)
    total = ev.agg(F.count_if(D.is_flagged()).alias("n")).scalar()
    return D.high_risk_projection(S.seeds(ev), total)


@query("log_search_totals", EV + """
SELECT count(*) AS hits FROM ev WHERE contains(lower(message), 'purchase')
  OR contains(lower(COALESCE(cmd, '') || ' ' || COALESCE(path, '')), 'shadow')""")
def log_search_totals(spark, folder):
    ev = unified_events(spark, folder)
    return D.search(ev, "purchase shadow").agg(F.count(F.lit(1)).alias("hits"))


@query("log_search_values", EV + r"""
SELECT 'backslash' AS what, count(*) FILTER (WHERE contains(lower(COALESCE(exe, '')), 'c:\windows')) AS hits FROM ev
UNION ALL SELECT 'name of a field', 0""")
def log_search_values(spark, folder):
    """Values with a backslash are found as they are, and names of fields are not."""
    ev, hits = unified_events(spark, folder), F.count(F.lit(1)).alias("hits")
    paths = D.search(ev, "c:\\windows", ["process"]).agg(hits).withColumn("what", F.lit("backslash"))
    return paths.unionByName(D.search(ev, "command_line").agg(hits).withColumn("what", F.lit("name of a field")))


@query("log_page", EV + """
SELECT seq, iso_ts FROM ev WHERE contains(lower(message), 'purchase') ORDER BY ts DESC, seq DESC LIMIT 20 OFFSET 20""")
def log_page(spark, folder):
    return D.page(D.search(unified_events(spark, folder), "purchase"), 2, 20).select("seq", F.col("`@timestamp`").alias("iso_ts"))


@query("document_search", """
SELECT lang, count(*) AS hits, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE contains(lower(text), 'password') OR contains(lower(text), 'license') GROUP BY lang""")
def document_search(spark, folder):
    docs = load(spark, folder, "documents")
    return D.search(docs, "password license", ["text"]).groupBy("lang").agg(
        F.count(F.lit(1)).alias("hits"), F.sum("n_chars").cast("bigint").alias("chars"))


@query("category_counts", EV + "SELECT category, dataset, count(*) AS events FROM ev GROUP BY category, dataset")
def category_counts(spark, folder):
    return D.counts_by_category(unified_events(spark, folder))


@query("quality_report", EV + """
SELECT count(*) AS total, count(*) AS valid, CAST(0 AS BIGINT) AS invalid, 100.0::DOUBLE AS valid_percent FROM ev WHERE src_ip IS NOT NULL""")
def quality_report(spark, folder):
    return D.quality_report(unified_events(spark, folder))


@query("destination_quality", EV + """
SELECT dataset, count(*) AS total, count(dst_ip) AS valid, round(count(dst_ip) * 100.0 / count(*), 1) AS valid_percent FROM ev GROUP BY dataset""")
def destination_quality(spark, folder):
    """Share of events per data set that name a destination."""
    n, ok = F.count(F.lit(1)), F.count(col("destination.ip"))
    return unified_events(spark, folder).groupBy(col("event.dataset").alias("dataset")).agg(
        n.alias("total"), ok.alias("valid"), F.round(ok * 100.0 / n, 1).alias("valid_percent"))


@query("threat_presence", EV + """
SELECT technique IS NOT NULL AS has_threat, count(*) AS events FROM ev GROUP BY 1""")
def threat_presence(spark, folder):
    return D.threat_presence(unified_events(spark, folder))


@query("display_rows", EV + """
SELECT seq, eid AS id, '-' AS technique, COALESCE(tactic, '-') AS tactic, host, src_ip AS source_ip, COALESCE(dst_ip, '-') AS destination_ip,
  strftime(ts + INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S') AS time FROM ev""")
def display_rows(spark, folder):
    return D.display_row(unified_events(spark, folder))


@query("daily_index_sizes", EV + """
SELECT strftime(ts + INTERVAL 8 HOURS, '%Y.%m.%d') AS index_day, count(*) AS events FROM ev GROUP BY 1""")
def daily_index_sizes(spark, folder):
    return unified_events(spark, folder).groupBy(index_day(F.col("ts"), 8).alias("index_day")).agg(F.count(F.lit(1)).alias("events"))


@query("events_in_range", EV + """
SELECT seq, iso_ts FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' AND category = 'file' AND dataset = 'auditd'""")
def events_in_range(spark, folder):
    from emberwatch.sources.store import query_events
    return query_events(unified_events(spark, folder), "2024-01-10", "2024-01-12",
                        {"event.category": "file", "event.dataset": "auditd"}, size=None).select("seq", F.col("`@timestamp`").alias("iso_ts"))


@query("url_entropy", """
WITH c AS (SELECT page_id, url, unnest(string_split(url, '')) AS ch FROM pages),
f AS (SELECT page_id, url, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL)
SELECT page_id, round(-sum(n / length(url) * log2(n / length(url))), 2) AS entropy FROM f GROUP BY page_id, url""")
def url_entropy(spark, folder):
    return load(spark, folder, "pages").select("page_id", entropy(F.col("url")).alias("entropy"))
