"""Detection and tagging queries over the packaged starter rules."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from emberwatch.functions.columns import col, iso
from emberwatch.operators import detect as X
from emberwatch.operators import tagging as T
from emberwatch.operators.fields import with_logsource
from emberwatch.plans.registry import query
from emberwatch.plans.twins import EVENTS, with_
from emberwatch.sources.rules import load_rules
from emberwatch.sources.samples import grid_rules, rule_grid
from emberwatch.sources.tables import unified_events

STARTER = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "rules")
_CACHE: dict = {}
# The placeholder table of the starter rules.
PLACEHOLDERS = {"service_accounts": ["root", "www-data"], "drop_types": ["bin", "jsp"], "office_types": ["docx"]}


def starter_rules(spark):
    if "rules" not in _CACHE:
        values = X.collect_placeholders(spark.createDataFrame([(n, v) for n, vs in PLACEHOLDERS.items() for v in vs], "name string, value string"))
        _CACHE["rules"] = X.with_placeholders(X.collect_rules(load_rules(spark, STARTER)), values)
    return _CACHE["rules"]


LOGSOURCE = """
ls AS (SELECT *,
  CASE WHEN dataset = 'windows' THEN 'windows' WHEN dataset = 'cowrie' THEN 'cowrie' WHEN contains(dataset, 'zeek') THEN 'zeek' ELSE 'linux' END AS product,
  CASE WHEN dataset = 'windows' THEN CASE category WHEN 'process' THEN 'process_creation' WHEN 'file' THEN 'file_event'
         WHEN 'network' THEN 'network_connection' WHEN 'authentication' THEN 'authentication' END
       WHEN dataset = 'cowrie' THEN CASE category WHEN 'process' THEN 'process_creation' WHEN 'authentication' THEN 'authentication' END
       WHEN dataset = 'zeek.conn' THEN 'network_connection' WHEN dataset = 'zeek.dns' THEN 'dns'
       WHEN dataset = 'auditd' AND category = 'process' THEN 'process_creation' END AS kind,
  CASE WHEN contains(dataset, 'zeek') THEN split_part(dataset, '.', 2) END AS service,
  lower(COALESCE(cmd, '')) AS c, lower(COALESCE(exe, proc, '')) AS img
  FROM ev)
"""

# (rule id, title, level, techniques, tactics, predicate), in file order
_PC = "kind = 'process_creation'"
_RULES = [
    ("ew-any-of-them", "Tool Names Anywhere", "low", ["T1485"], [("TA0040", "Impact"), ("", "g0016")],
     f"{_PC} AND product <> 'cowrie' AND (ends_with(img, '/nc') OR ends_with(img, '/rm'))"),
    ("ew-base64-decode", "Base64 Decoded On The Command Line", "medium", ["T1140"], [("TA0005", "Defense Evasion")],
     f"{_PC} AND product = 'linux' AND contains(c, 'base64') AND (contains(c, ' -d') OR contains(c, '--decode'))"),
    ("ew-certutil-download", "Certutil Fetches a File", "high", ["T1105"], [("TA0011", "Command and Control")],
     f"{_PC} AND product = 'windows' AND ends_with(img, '\\certutil.exe') AND contains(c, 'urlcache') AND contains(c, 'http')"),
    ("ew-conn-ssh", "Connection To A Remote Shell Port", "medium", ["T1021.004"], [("TA0008", "Lateral Movement")],
     "dataset = 'zeek.conn' AND dst_port IN (22, 3389) AND proto IN ('ssh', 'http')"),
    ("ew-dns-internal", "Name Lookup To An Internal Range", "low", ["T1071.004"], [("TA0011", "Command and Control")],
     "dataset = 'zeek.dns' AND (dst_ip LIKE '172.16.0.%' OR dst_ip LIKE '172.16.1.%')"),
    ("ew-download-run", "Download Piped Into A Shell", "critical", ["T1105", "T1059.004"],
     [("TA0011", "Command and Control"), ("TA0002", "Execution")],
     f"{_PC} AND (contains(c, 'curl ') OR contains(c, 'wget ')) AND contains(c, '| bash')"),
    ("ew-encoded-payload", "Known Payload In Base64", "low", ["T1027"], [("TA0005", "Defense Evasion")],
     f"{_PC} AND contains(cmd, 'aGk=')"),
    ("ew-honeypot-command", "Command Typed Into A Honeypot", "medium", ["T1059.004"], [("TA0002", "Execution")],
     f"{_PC} AND product = 'cowrie' AND action = 'input' AND NOT starts_with(c, 'ls ')"),
    ("ew-honeypot-root", "Honeypot Login As Root", "medium", ["T1078", "T1110"], [("TA0001", "Initial Access")],
     "product = 'cowrie' AND user_name = 'root' AND action = 'login'"),
    ("ew-keyword", "Sensitive Words In A Message", "low", ["T1082"], [],
     "product = 'linux' AND (contains(message, 'error {\"k\": 7') OR contains(message, 'view {\"k\": 13}'))"),
    ("ew-linux-rename", "Rename Action On A Host", "low", [], [("TA0005", "Defense Evasion")],
     "product = 'linux' AND action = 'rename'"),
    ("ew-log-wipe", "Log Directory Removed", "high", ["T1070"], [("TA0005", "Defense Evasion")],
     f"{_PC} AND product = 'linux' AND (CAST(starts_with(c, 'rm ') AS INT) + CAST(contains(c, '-rf') AS INT) + CAST(ends_with(c, '/var/log') AS INT)) >= 2"),
    ("ew-null-parent", "Process Without Parent Image", "informational", ["T1055"], [("TA0004", "Privilege Escalation")],
     f"{_PC} AND product = 'windows' AND contains(img, 'system32')"),
    ("ew-netcat-exec", "Netcat Runs A Program", "high", ["T1059"], [("TA0002", "Execution")],
     f"{_PC} AND product = 'linux' AND (ends_with(img, '/nc') OR ends_with(img, '/ncat')) AND contains(c, ' -e ')"),
    ("ew-passwd-read", "Account File Read From The Shell", "medium", ["T1003.008"], [("TA0006", "Credential Access")],
     f"{_PC} AND product = 'linux' AND (c = 'cat /etc/passwd' OR starts_with(c, 'cat /etc/shadow'))"),
    ("ew-ps-encoded", "Encoded PowerShell Command", "high", ["T1059.001", "T1027"], [("TA0002", "Execution"), ("TA0005", "Defense Evasion")],
     f"{_PC} AND product = 'windows' AND ends_with(img, '\\powershell.exe') AND contains(c, '-enc')"),
    ("ew-reverse-shell", "Interactive Shell Over A Socket", "critical", ["T1059.004"], [("TA0002", "Execution")],
     f"{_PC} AND product = 'linux' AND regexp_matches(cmd, '/dev/tcp/[0-9.]+/[0-9]{{2,5}}')"),
    ("ew-whoami-windows", "Identity Discovery On Windows", "low", ["T1033"], [("TA0007", "Discovery")],
     f"{_PC} AND product = 'windows' AND ends_with(img, '\\whoami.exe') AND NOT ends_with(c, ' /user')"),
    ("ew-web-script", "Script Started From The Web Root", "high", ["T1505.003"], [("TA0003", "Persistence")],
     f"{_PC} AND product = 'linux' AND regexp_matches(c, '/var/www/.*\\.php$')"),
    ("ew-win-file", "Script File Written Below The Web Root", "medium", ["T1505.003"], [("TA0003", "Persistence")],
     "product = 'windows' AND kind = 'file_event' AND (ends_with(path, '.jsp') OR ends_with(path, '.docx'))"),
    ("ew-win-logon", "Failed Logon Of A Service Account", "medium", ["T1110.001"], [("TA0006", "Credential Access")],
     "product = 'windows' AND kind = 'authentication' AND user_name IN ('root', 'www-data') AND outcome = 'failure'"),
    ("ew-zeek-subnet", "Uncommon Protocol From A Known Subnet", "low", ["T1046"], [("TA0007", "Discovery")],
     "product = 'zeek' AND (src_ip LIKE '10.0.1.%' OR src_ip LIKE '10.0.3.%') AND proto NOT IN ('dns', 'http', 'https')"),
    ("ew-expand-accounts", "File Touched By A Service Account", "low", ["T1078"], [("TA0003", "Persistence")],
     "product = 'windows' AND kind = 'file_event' AND user_name IN ('root', 'www-data') AND regexp_matches(lower(path), '[.](bin|jsp|docx)$')"),
]


def _sq(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


HITS = "hits AS (" + " UNION ALL ".join(
    f"SELECT *, {_sq(i)} AS rule_id, {n} AS pos, {_sq(t)} AS title, {_sq(lv)} AS level FROM ls WHERE {p}"
    for n, (i, t, lv, _, _, p) in enumerate(_RULES)) + ")"
_PAIRS = [(i, n, tn, te[0], te[1]) for n, (i, _, _, techs, tacs, _) in enumerate(_RULES) for tn in techs for te in tacs]
TAGGED = "pairs(rule_id, technique_id, tactic_id, tactic_name) AS (VALUES " + ", ".join(
    f"({_sq(i)}, {_sq(tn)}, {_sq(a)}, {_sq(b)})" for i, _, tn, a, b in _PAIRS) + (
    "), tagged AS (SELECT h.*, technique_id, tactic_id, tactic_name FROM hits h JOIN pairs USING (rule_id))")
NODES = """
firsts AS (SELECT technique_id, tactic_id, arg_min(level, seq * 1000 + pos) AS level, arg_min(tactic_name, seq * 1000 + pos) AS tactic_name,
   count(DISTINCT eid) AS event_count, min(iso_ts) AS first_seen, max(iso_ts) AS last_seen,
   array_to_string(list_sort(list(DISTINCT title)), '|') AS matched_rules FROM tagged GROUP BY technique_id, tactic_id),
per AS (SELECT technique_id, tactic_id, eid, min(seq) AS s, count(*) AS h FROM tagged GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY technique_id, tactic_id ORDER BY s) AS r FROM per),
gain AS (SELECT technique_id, tactic_id, sum(h * (r - 1)) AS steps FROM rk GROUP BY ALL),
nodes AS (SELECT f.*,
   round(CASE WHEN steps > 0 THEN least(0.99, b + 0.05 * steps) ELSE b END, 4) AS confidence,
   CASE level WHEN 'informational' THEN 'low' ELSE level END AS severity
  FROM (SELECT *, CASE level WHEN 'low' THEN 0.3 WHEN 'medium' THEN 0.6 WHEN 'high' THEN 0.85 WHEN 'critical' THEN 0.95 ELSE 0.5 END AS b FROM firsts) f
  JOIN gain USING (technique_id, tactic_id))
"""
H = with_(EVENTS, LOGSOURCE, HITS)
TG = with_(EVENTS, LOGSOURCE, HITS, TAGGED)
ND = with_(EVENTS, LOGSOURCE, HITS, TAGGED, NODES)
_KEEP = ["seq", "ts", "event", "source", "destination", "process", "user", "host"]


def _hits(spark, folder, **kw):
    return X.detect(unified_events(spark, folder), starter_rules(spark), keep=_KEEP, **kw)


def _nodes(spark, folder):
    return T.technique_nodes(T.tag_hits(_hits(spark, folder)))


@query("event_logsources", with_(EVENTS, LOGSOURCE) + """
SELECT product, COALESCE(kind, '-') AS category, COALESCE(service, '-') AS service, count(*) AS events FROM ls GROUP BY ALL""")
def event_logsources(spark, folder):
    dash = lambda c: F.coalesce(F.col(c), F.lit("-"))
    return with_logsource(unified_events(spark, folder)).groupBy(
        F.col("ls_product").alias("product"), dash("ls_category").alias("category"), dash("ls_service").alias("service")).agg(
        F.count(F.lit(1)).alias("events"))


@query("rule_hits", H + "SELECT seq, rule_id, title, level FROM hits")
def rule_hits(spark, folder):
    return _hits(spark, folder).select("seq", "rule_id", "title", "level")


@query("rule_hit_counts", H + "SELECT rule_id, count(*) AS events, count(DISTINCT host) AS hosts FROM hits GROUP BY rule_id")
def rule_hit_counts(spark, folder):
    return _hits(spark, folder).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct(col("host.name")).alias("hosts"))


_GRID = "grid(rule_id, product, tail, p1, p2, quiet) AS (VALUES " + ", ".join(
    f"({_sq(i)}, {_sq(product)}, {_sq(image)}, {_sq(parts[0])}, {_sq(parts[-1])}, {_sq(start)})" for i, product, image, parts, start in rule_grid()) + ")"


@query("large_rule_set_hits", with_(EVENTS, LOGSOURCE, _GRID) + """
SELECT rule_id, count(*) AS events, count(DISTINCT host) AS hosts FROM ls JOIN grid g
 ON ls.product = g.product AND kind = 'process_creation' AND ends_with(img, tail) AND contains(c, lower(p1)) AND contains(c, lower(p2)) AND NOT starts_with(c, quiet)
GROUP BY rule_id""")
def large_rule_set_hits(spark, folder):
    """3,600 rules over all events, through the literal automaton."""
    hits = X.detect(unified_events(spark, folder), grid_rules(), keep=["seq", "host"])
    return hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("events"), F.count_distinct(col("host.name")).alias("hosts"))


@query("rule_matched_fields", H + """
SELECT rule_id, field, value, count(*) AS events FROM (
  SELECT rule_id, 'Image' AS field, COALESCE(exe, proc) AS value FROM hits WHERE rule_id IN ('ew-ps-encoded', 'ew-certutil-download')
  UNION ALL SELECT rule_id, 'CommandLine', cmd FROM hits WHERE rule_id IN ('ew-ps-encoded', 'ew-certutil-download', 'ew-passwd-read')
) GROUP BY ALL""")
def rule_matched_fields(spark, folder):
    rules = [r for r in starter_rules(spark) if r.id in ("ew-ps-encoded", "ew-certutil-download", "ew-passwd-read")]
    hits = X.detect(unified_events(spark, folder), rules, report_fields=True, keep=["seq"])
    return hits.select("rule_id", F.explode("matched_fields").alias("f")).groupBy(
        "rule_id", F.col("f.field").alias("field"), F.col("f.value").alias("value")).agg(F.count(F.lit(1)).alias("events"))


@query("rule_stats_on_hits", H + """
SELECT level, product, count(*) AS hits, count(DISTINCT rule_id) AS rules FROM hits GROUP BY level, product""")
def rule_stats_on_hits(spark, folder):
    hits = X.detect(with_logsource(unified_events(spark, folder)).drop("ls_category", "ls_service", "ls_audit", "ls_honeypot")
                    .withColumnRenamed("ls_product", "event_product"), starter_rules(spark))
    return hits.groupBy("level", F.col("event_product").alias("product")).agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct("rule_id").alias("rules"))


@query("technique_tags", TG + """
SELECT technique_id, tactic_id, tactic_name, count(*) AS hits FROM tagged GROUP BY ALL""")
def technique_tags(spark, folder):
    return T.tag_hits(_hits(spark, folder)).groupBy("technique_id", "tactic_id", "tactic_name").agg(F.count(F.lit(1)).alias("hits"))


@query("technique_nodes", ND + """
SELECT technique_id, tactic_id, tactic_name, confidence, severity, event_count, first_seen, last_seen, matched_rules FROM nodes""")
def technique_nodes(spark, folder):
    return _nodes(spark, folder).select(
        "technique_id", "tactic_id", "tactic_name", F.round("confidence", 4).alias("confidence"), "severity", "event_count",
        iso(F.col("first_seen")).alias("first_seen"), iso(F.col("last_seen")).alias("last_seen"),
        F.array_join("matched_rules", "|").alias("matched_rules"))


@query("technique_context", TG + """
SELECT technique_id, tactic_id, kind, value, count(DISTINCT seq) AS events FROM (
  SELECT technique_id, tactic_id, seq, 'source_ip' AS kind, src_ip AS value FROM tagged
  UNION ALL SELECT technique_id, tactic_id, seq, 'dest_ip', dst_ip FROM tagged
  UNION ALL SELECT technique_id, tactic_id, seq, 'process', proc FROM tagged
  UNION ALL SELECT technique_id, tactic_id, seq, 'process', exe FROM tagged WHERE exe <> proc
  UNION ALL SELECT technique_id, tactic_id, seq, 'user', user_name FROM tagged
  UNION ALL SELECT technique_id, tactic_id, seq, 'host', host FROM tagged
  UNION ALL SELECT technique_id, tactic_id, seq, 'host', hostname FROM tagged
) WHERE value IS NOT NULL GROUP BY ALL""")
def technique_context(spark, folder):
    ev = unified_events(spark, folder).withColumn("context", T.context())
    return T.technique_context(T.tag_hits(X.detect(ev, starter_rules(spark), keep=["seq", "context"])))


@query("nodes_of_tactic", ND + "SELECT technique_id, event_count FROM nodes WHERE tactic_id = 'TA0002'")
def nodes_of_tactic(spark, folder):
    return T.nodes_of_tactic(_nodes(spark, folder), "TA0002").select("technique_id", "event_count")


@query("attack_summary", ND + """
, s AS (SELECT count(*) AS total_techniques, CAST(sum(event_count) AS BIGINT) AS total_events,
  CASE max(severity) WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 2 END * max(confidence) AS r,
  min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM nodes)
SELECT total_techniques, total_events, CASE WHEN r >= 3.5 THEN 'critical' WHEN r >= 2.5 THEN 'high' WHEN r >= 1.5 THEN 'medium' ELSE 'low' END AS risk_level,
  round(r, 2) AS risk_score, first_seen, last_seen FROM s""")
def attack_summary(spark, folder):
    return T.attack_summary(_nodes(spark, folder)).withColumns({"first_seen": iso(F.col("first_seen")), "last_seen": iso(F.col("last_seen"))})


@query("attack_chain", ND + """
SELECT array_position(['TA0043','TA0042','TA0001','TA0002','TA0003','TA0004','TA0005','TA0006','TA0007','TA0008','TA0009','TA0011','TA0010','TA0040'], tactic_id) - 1 AS stage,
  tactic_id, min(tactic_name) AS tactic_name, string_agg(technique_id || ':' || event_count, ',' ORDER BY technique_id) AS techniques
FROM nodes WHERE tactic_id <> '' GROUP BY tactic_id""")
def attack_chain(spark, folder):
    return T.attack_chain(_nodes(spark, folder)).select(
        "stage", "tactic_id", "tactic_name",
        F.array_join(F.transform("techniques", lambda t: F.concat_ws(":", t["technique_id"], t["event_count"].cast("string"))), ",").alias("techniques"))


ANALYZED = TG + """
, per_hit AS (SELECT seq, string_agg(DISTINCT title, '|' ORDER BY title) AS rules FROM hits GROUP BY seq),
prim AS (SELECT seq, arg_min(rule_id, pos) AS rule_id FROM hits WHERE rule_id IN (SELECT rule_id FROM pairs) GROUP BY seq),
firstpair AS (SELECT rule_id, first(technique_id) AS technique_id, first(tactic_id) AS tactic_id FROM (SELECT * FROM pairs) GROUP BY rule_id),
res AS (SELECT e.seq, e.host, e.technique AS upstream,
   CASE WHEN p.rules IS NOT NULL THEN p.rules WHEN e.technique IS NOT NULL THEN 'Upstream Detection: ' || e.technique ELSE '' END AS matched_rules,
   CASE WHEN p.rules IS NOT NULL THEN f.technique_id ELSE e.technique END AS technique_id,
   CASE WHEN p.rules IS NULL AND e.technique IS NOT NULL THEN TRUE ELSE FALSE END AS passed
  FROM ls e LEFT JOIN per_hit p USING (seq) LEFT JOIN prim USING (seq) LEFT JOIN firstpair f ON f.rule_id = prim.rule_id)
"""


@query("analyzed_events", ANALYZED + "SELECT seq, technique_id IS NOT NULL AS detected, matched_rules, technique_id FROM res")
def analyzed_events(spark, folder):
    return T.analyze(unified_events(spark, folder), starter_rules(spark)).select(
        "seq", "detected", F.array_join("matched_rules", "|").alias("matched_rules"), F.col("primary.technique_id").alias("technique_id"))


@query("upstream_events", ANALYZED + "SELECT technique_id, count(*) AS events FROM res WHERE passed GROUP BY technique_id")
def upstream_events(spark, folder):
    a = T.analyze(unified_events(spark, folder), starter_rules(spark))
    return T.upstream_only(a).groupBy(F.col("primary.technique_id").alias("technique_id")).agg(F.count(F.lit(1)).alias("events"))


@query("detection_report", ANALYZED + """
SELECT count(*) AS analyzed_events, count(technique_id) AS detected_events, round(count(technique_id) / count(*) * 100, 2) AS detection_rate FROM res""")
def detection_report(spark, folder):
    return T.batch_report(T.analyze(unified_events(spark, folder), starter_rules(spark)))


@query("exported_threats", ANALYZED + """
SELECT COALESCE(technique_id, upstream, '-') AS technique_id, count(*) AS events FROM res GROUP BY 1""")
def exported_threats(spark, folder):
    ev = unified_events(spark, folder)
    out = T.export_events(T.analyze(ev, starter_rules(spark)), ev.columns)
    return out.groupBy(F.coalesce(col("threat.technique.id"), F.lit("-")).alias("technique_id")).agg(F.count(F.lit(1)).alias("events"))


@query("case_techniques_by_rule", TG + "SELECT case_id, count(DISTINCT technique_id) AS techniques FROM tagged GROUP BY case_id")
def case_techniques_by_rule(spark, folder):
    hits = X.detect(unified_events(spark, folder), starter_rules(spark), keep=["case_id"])
    return hits.select("case_id", F.explode("techniques").alias("t"), "tactics").where(F.size("tactics") > 0).groupBy("case_id").agg(
        F.count_distinct("t").alias("techniques"))
