"""Parser, normaliser and behaviour queries over log lines derived from the tables."""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.columns import col, decode_hex, fence, iso, parse_iso, rejected
from emberwatch.operators import behavior as B
from emberwatch.operators import labels as L
from emberwatch.plans.registry import query
from emberwatch.plans.twins import EVENTS, LABELS, at, isin, lst, q, with_
from emberwatch.schema import conform, to_documents
from emberwatch.sources import audit, honeypot, memory, samples, store, windows, zeek
from emberwatch.sources import tables as A

MIXED_BITS = round(-sum(n / len(samples.MIXED_NAME) * math.log2(n / len(samples.MIXED_NAME)) for n in Counter(samples.MIXED_NAME).values()), 2)

RAW = """
raw AS (SELECT event_id AS id, ts, user_id AS uid, event_type, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)
"""
AUDIT = f"""
aud AS (SELECT *, 'audit-' || (uid % 3) AS file, id * 8 AS line,
   event_type = 'signup' AS login,
   CASE WHEN k % 17 <> 0 THEN CAST(uid % 40 AS VARCHAR) END AS ses,
   CASE WHEN event_type = 'signup' THEN CASE WHEN k % 10 = 0 THEN '?' ELSE '10.1.' || (uid % 4) || '.' || k END END AS addr,
   {at(A.COMMANDS, "k % 12")} AS cmd, {at(A.EXECUTABLES, "k % 12")} AS exe, {at(samples.COMMS, "k % 14")} AS comm, {at(A.FILES, "k % 10")} AS path,
   CASE WHEN k % 4 = 0 THEN '0' ELSE CAST(1000 + uid AS VARCHAR) END AS account,
   CASE WHEN k % 11 = 1 THEN 'www-data' ELSE CAST(uid AS VARCHAR) END AS auid,
   k % 9 = 0 AS failed FROM raw),
known AS (SELECT *, CASE WHEN ses IS NULL THEN NULL ELSE last_value(CASE WHEN addr <> '?' THEN addr END IGNORE NULLS) OVER (PARTITION BY file, ses ORDER BY line) END AS origin FROM aud),
grp AS (SELECT id, file, login, k,
   CASE WHEN login THEN 'authentication' ELSE 'process' END AS category,
   CASE WHEN failed THEN 'failure' ELSE 'success' END AS outcome,
   CASE WHEN login THEN CASE WHEN failed THEN 4 ELSE 1 END
        WHEN regexp_matches(path, '/etc/passwd|/etc/shadow|\\.ssh|/etc/sudoers') THEN 10
        WHEN account = '0' THEN 8 WHEN failed THEN 4 ELSE 1 END AS severity,
   CASE WHEN login THEN addr ELSE origin END AS source_ip,
   CASE WHEN NOT login THEN comm END AS name, CASE WHEN NOT login THEN cmd END AS command, CASE WHEN NOT login THEN path END AS path,
   CASE WHEN NOT login THEN auid END AS user_name, CASE WHEN NOT login THEN account END AS account, ses FROM known)
"""
AU = with_(RAW, AUDIT)


def _audit(spark, folder, mode="by_id"):
    groups = audit.group_records(audit.parse_lines(samples.audit_lines(spark, folder)), mode)
    return audit.group_events(groups, "sensor-1")


@query("audit_records", with_(RAW) + """
SELECT type, count(*) AS records, count(DISTINCT id) AS groups FROM (
  SELECT id, unnest(CASE WHEN event_type = 'signup' THEN ['USER_LOGIN'] WHEN k % 3 = 0 THEN ['SYSCALL', 'EXECVE', 'CWD', 'PATH', 'PATH']
    ELSE ['SYSCALL', 'EXECVE', 'CWD', 'PATH', 'PATH', 'EOE'] END) AS type FROM raw) GROUP BY type""")
def audit_records(spark, folder):
    p = audit.parse_lines(samples.audit_lines(spark, folder))
    return p.groupBy(F.try_element_at("kv", F.lit("type")).alias("type")).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("audit_id").alias("groups"))


@query("audit_events", AU + """
SELECT id + 1000 AS audit_id, file, category, outcome, severity, COALESCE(source_ip, '-') AS source_ip, COALESCE(name, '-') AS name,
  COALESCE(command, '-') AS command, COALESCE(path, '-') AS path, COALESCE(user_name, '-') AS user_name FROM grp""")
def audit_events(spark, folder):
    dash = lambda p: F.coalesce(col(p), F.lit("-"))
    return _audit(spark, folder).select(
        F.col("audit_id").cast("bigint").alias("audit_id"), F.col("log_file").alias("file"), col("event.category").alias("category"), col("event.outcome").alias("outcome"),
        col("event.severity").alias("severity"), dash("source.ip").alias("source_ip"), dash("process.name").alias("name"),
        dash("process.command_line").alias("command"), dash("file.path").alias("path"), dash("user.name").alias("user_name"))


@query("audit_contiguous_groups", with_(RAW) + """
, g AS (SELECT id, 'audit-' || (uid % 3) AS file, event_type <> 'signup' AND k % 3 <> 0 AS closed,
   CASE WHEN event_type = 'signup' THEN 1 WHEN k % 3 = 0 THEN 5 ELSE 6 END AS n FROM raw),
o AS (SELECT *, lead(id) OVER (PARTITION BY file ORDER BY id) IS NULL AS final FROM g)
SELECT file, count(*) AS groups, CAST(sum(n) AS BIGINT) AS records FROM o WHERE closed OR NOT final GROUP BY file""")
def audit_contiguous_groups(spark, folder):
    """The collector's own grouping; the group still open at the end of a file is not emitted."""
    g = audit.group_records(audit.parse_lines(samples.audit_lines(spark, folder)), "contiguous", block=4000)
    return g.groupBy("file").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.size("records")).cast("bigint").alias("records"))


@query("audit_ingest", AU + f"""
, kept AS (SELECT *, CASE WHEN regexp_matches(COALESCE(command, ''), '/etc/passwd|/etc/shadow|\\.ssh|authorized_keys') THEN 10
    WHEN account = '0' AND login THEN 8 ELSE severity END AS level
  FROM grp WHERE NOT (COALESCE(name, '') IN {isin(audit.NOISE)} AND NOT (name = 'sleep' AND contains(command, ' 9001')) AND COALESCE(user_name, '') <> 'www-data'))
SELECT category, level AS severity, count(*) AS events FROM kept GROUP BY category, level""")
def audit_ingest(spark, folder):
    out = audit.align_severity(audit.ingest_filter(_audit(spark, folder)))
    return out.groupBy(col("event.category").alias("category"), col("event.severity").alias("severity")).agg(F.count(F.lit(1)).alias("events"))


@query("audit_unfiltered", AU + "SELECT category, count(*) AS events FROM grp GROUP BY category")
def audit_unfiltered(spark, folder):
    return audit.ingest_filter(_audit(spark, folder), filtered=False).groupBy(col("event.category").alias("category")).agg(F.count(F.lit(1)).alias("events"))


@query("raw_log_events", "SELECT 'raw_log' AS category, count(*) AS events, CAST(sum(length(trim(text))) AS BIGINT) AS chars FROM documents WHERE NOT contains(text, 'type=') AND NOT contains(text, 'msg=audit') AND trim(text) <> ''")
def raw_log_events(spark, folder):
    docs = A.load(spark, folder, "documents").select(F.col("text").alias("value"), F.col("source").alias("file"), F.col("doc_id").alias("line_no"))
    return audit.raw_events(docs).groupBy(col("event.category").alias("category")).agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.length("message")).cast("bigint").alias("chars"))


ZEEK = f"""
z AS (SELECT *, ({lst(samples.ZEEK_LOGS)})[k % 5 + 1] AS log,
   CASE WHEN k % 7 = 0 THEN {q(samples.LONG_NAME)} WHEN k % 11 = 0 THEN {q(samples.DEEP_NAME)} WHEN k % 13 = 0 THEN {q(samples.MIXED_NAME)} ELSE 'h' || k || '.example.com' END AS name
  FROM raw WHERE k % 50 <> 49),
zz AS (SELECT *, log = 'dns' AND (length(name) > 70 OR len(string_split(name, '.')) > 7 OR k % 7 <> 0 AND k % 11 <> 0 AND k % 13 = 0) AS tunnel,
   log = 'conn' AND k % 3 = 0 AND k * 20 > 800 AS icmp, log = 'ssl' AND k % 4 IN (1, 2) AS weak FROM z)
"""


@query("zeek_events", with_(RAW, ZEEK) + """
SELECT id AS seq, 'zeek.' || log AS dataset, CASE WHEN log = 'files' THEN 'file' ELSE 'network' END AS category, CASE WHEN tunnel OR icmp OR weak THEN 7 ELSE 3 END AS severity,
  CASE WHEN tunnel OR icmp THEN 'T1071.004' WHEN weak THEN 'T1573' ELSE '-' END AS technique, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM zz""")
def zeek_events(spark, folder):
    ev = zeek.zeek_events(zeek.parse_lines(samples.zeek_lines(spark, folder)), "sensor-1", {"seq": F.col("seq")})
    return ev.select("seq", col("event.dataset").alias("dataset"), col("event.category").alias("category"), col("event.severity").alias("severity"),
                     F.coalesce(col("threat.technique.id"), F.lit("-")).alias("technique"), F.substring("@timestamp", 1, 19).alias("at"))


@query("zeek_messages", with_(RAW, ZEEK) + f"""
SELECT message, count(*) AS events FROM (SELECT CASE
    WHEN tunnel AND name = {q(samples.LONG_NAME)} THEN 'DNS tunnel [Length(' || length(name) || ')]: ' || name
    WHEN tunnel AND name = {q(samples.DEEP_NAME)} THEN 'DNS tunnel [Depth(' || len(string_split(name, '.')) || ')]: ' || name
    WHEN tunnel THEN 'DNS tunnel [Entropy({MIXED_BITS})]: ' || name
    WHEN log = 'dns' THEN 'DNS Query: ' || name WHEN icmp THEN 'Suspected ICMP tunnel'
    WHEN log = 'conn' THEN 'Conn: ' || (['icmp', 'tcp', 'udp'])[k % 3 + 1] || ' flow'
    WHEN weak THEN 'Weak encryption: ' || ({lst(samples.TLS)})[k % 4 + 1] WHEN log = 'ssl' THEN 'SSL/TLS Handshake: ' || ({lst(samples.TLS)})[k % 4 + 1]
    WHEN log = 'http' THEN 'HTTP GET site.example/p/' || k ELSE 'File in transit: f' || k END AS message FROM zz) GROUP BY message""")
def zeek_messages(spark, folder):
    return zeek.zeek_events(zeek.parse_lines(samples.zeek_lines(spark, folder)), "sensor-1").groupBy("message").agg(F.count(F.lit(1)).alias("events"))


POT = f"""
pot AS (SELECT *, ({lst(samples.POT_EVENTS)})[k % 6 + 1] AS kind, CASE WHEN k % 12 <> 8 THEN ({lst(A.COMMANDS)})[CAST(floor(k / 2) AS INTEGER) % 12 + 1] END AS input FROM raw),
pp AS (SELECT *, CASE WHEN kind LIKE '%login%' THEN 'authentication' WHEN kind = 'cowrie.command.input' THEN 'process' ELSE 'host' END AS category,
   CASE WHEN kind <> 'cowrie.command.input' OR input IS NULL THEN NULL WHEN contains(input, 'curl') OR contains(input, 'wget') THEN 'T1105'
     WHEN regexp_matches(input, '/etc/passwd|/etc/shadow|whoami') THEN 'T1087' WHEN regexp_matches(input, 'rm |mv |chmod') THEN 'T1070' END AS technique
  FROM pot WHERE kind IN {isin(honeypot.KEPT)})
"""


@query("broken_lines", with_(RAW) + """
SELECT 'honeypot' AS source, id % 7 = 0 AS broken, count(*) AS lines FROM raw GROUP BY id % 7 = 0
UNION ALL SELECT 'sensor', id % 7 = 0, count(*) FROM raw WHERE k % 50 <> 49 GROUP BY id % 7 = 0
UNION ALL SELECT 'event', id % 7 = 0, count(*) FROM raw GROUP BY id % 7 = 0""")
def broken_lines(spark, folder):
    """Lines read and refused by source, where every seventh line is cut off."""
    pot, net = (samples.with_broken(f(spark, folder)) for f in (samples.honeypot_lines, samples.zeek_lines))
    sides = [("honeypot", honeypot.parse_lines(pot, all_events=True), rejected(pot)), ("sensor", zeek.parse_lines(net), rejected(net)),
             ("event", conform(pot), rejected(pot))]
    counts = [part.select(F.lit(name).alias("source"), F.lit(bad).alias("broken")).groupBy("source", "broken").agg(F.count(F.lit(1)).alias("lines"))
              for name, good, lost in sides for bad, part in ((False, good), (True, lost))]
    return reduce(DataFrame.unionByName, counts)


@query("honeypot_events", with_(RAW, POT) + """
SELECT id AS seq, category, split_part(kind, '.', 3) AS action, CASE WHEN kind = 'cowrie.login.failed' THEN 'failure' ELSE 'success' END AS outcome,
  CASE WHEN kind = 'cowrie.login.failed' THEN 5 WHEN kind = 'cowrie.login.success' THEN 1 WHEN kind <> 'cowrie.command.input' THEN 3 WHEN input IS NULL THEN 3
    WHEN technique = 'T1105' THEN 8 WHEN technique = 'T1087' THEN 7 WHEN technique = 'T1070' THEN 6 ELSE 5 END AS severity,
  COALESCE(technique, '-') AS technique, CASE WHEN category = 'process' AND input IS NOT NULL THEN split_part(input, ' ', 1) ELSE '-' END AS tool FROM pp""")
def honeypot_events(spark, folder):
    ev = honeypot.honeypot_events(honeypot.parse_lines(samples.honeypot_lines(spark, folder)), "pot-1", {"seq": F.col("seq")})
    return ev.select("seq", col("event.category").alias("category"), col("event.action").alias("action"), col("event.outcome").alias("outcome"),
                     col("event.severity").alias("severity"), F.coalesce(col("threat.technique.id"), F.lit("-")).alias("technique"),
                     F.coalesce(col("process.name"), F.lit("-")).alias("tool"))


WIN = f"""
win AS (SELECT *, ({lst(samples.WINDOWS_IDS)})[k % 6 + 1] AS eid, CASE WHEN k % 5 = 0 THEN '-' ELSE CASE WHEN k % 2 = 0 THEN '::ffff:' ELSE '' END || '192.168.7.' || k END AS ip,
  {at(A.EXECUTABLES, "k % 12")} AS exe, {at(A.FILES, "k % 10")} AS obj FROM raw),
ww AS (SELECT *, CASE eid WHEN 4624 THEN CASE WHEN ip <> '-' THEN ip END WHEN 4768 THEN replace(ip, '::ffff:', '') WHEN 4776 THEN 'WS' || (uid % 9) END AS source_ip FROM win)
"""


@query("windows_events", with_(RAW, WIN) + """
SELECT id, COALESCE(CASE WHEN eid IN (4624, 4768, 4776) THEN 'iam' WHEN eid = 4688 THEN 'process' WHEN eid = 4663 THEN 'file' END, '-') AS category,
  COALESCE(CASE eid WHEN 4624 THEN 'login-success' WHEN 4768 THEN 'login-attempt-domain' WHEN 4776 THEN 'login-attempt-ntlm' WHEN 4688 THEN 'process_created' WHEN 4663 THEN 'access' END, '-') AS action,
  CASE WHEN eid IN (4624, 4768) THEN 1 ELSE 5 END AS severity, COALESCE(source_ip, '-') AS source_ip, CASE WHEN eid = 4688 THEN 1000 + uid ELSE 0 END AS pid,
  CASE WHEN eid = 4688 THEN uid % 20 + 4 ELSE 0 END AS ppid,
  COALESCE(CASE WHEN eid = 4688 THEN regexp_extract(exe, '[^\\\\]*$') WHEN eid = 4663 THEN regexp_extract(obj, '[^\\\\]*$') END, '-') AS name,
  CASE WHEN source_ip IS NOT NULL AND source_ip <> '-' THEN 'Remote-Host-' || source_ip ELSE 'dc-1' END AS host FROM ww""")
def windows_events(spark, folder):
    ev = windows.normalise_records(samples.windows_records(spark, folder), {"id": F.col("event_id")})
    ev = windows.blank_addresses(windows.attribute_remote(ev, "dc-1"))
    dash = lambda c: F.coalesce(c, F.lit("-"))
    return ev.select("id", dash(col("event.category")).alias("category"), dash(col("event.action")).alias("action"), col("event.severity").alias("severity"),
                     dash(col("source.ip")).alias("source_ip"), F.coalesce(col("process.pid"), F.lit(0)).alias("pid"),
                     F.coalesce(col("process.parent.pid"), F.lit(0)).alias("ppid"), dash(F.coalesce(col("process.name"), col("file.name"))).alias("name"),
                     col("host.name").alias("host"))


MAPS = f"""
mp AS (SELECT *, ({lst(samples.PERMS)})[k % 4 + 1] AS perms, trim(({lst(samples.MAPPED)})[k % 5 + 1]) AS path, k % 2 = 0 AS elf, {at(A.PROCESSES, "k % 12")} AS comm FROM raw),
mm AS (SELECT *, contains(path, '/memfd:') AS memfd, path = '' AS anon, contains(perms, 'wx') AS wx, contains(perms, 'rwx') AS rwx FROM mp WHERE contains(perms, 'x')),
an AS (SELECT *, elf AND (memfd OR anon OR rwx) AS is_elf FROM mm),
reg AS (SELECT *, CASE WHEN memfd THEN 'MEMFD_EXEC' WHEN wx THEN 'RWX_REGION' WHEN anon AND is_elf THEN 'ANON_ELF' END AS kind,
   CASE WHEN memfd AND is_elf THEN 'CRITICAL' WHEN memfd THEN 'HIGH' WHEN wx AND is_elf THEN 'CRITICAL' WHEN wx AND anon THEN 'HIGH'
        WHEN wx AND (path = '[stack]' OR path = '[heap]') THEN 'CRITICAL' WHEN wx THEN 'MEDIUM' ELSE 'HIGH' END AS risk,
   CASE WHEN memfd AND is_elf THEN 1.0 WHEN memfd THEN 0.8 WHEN wx AND is_elf THEN 1.0 WHEN wx AND anon THEN 0.85
        WHEN wx AND (path = '[stack]' OR path = '[heap]') THEN 0.95 WHEN wx THEN 0.5 ELSE 0.9 END AS confidence FROM an)
"""


@query("memory_regions", with_(RAW, MAPS) + """
SELECT id AS event_id, 1000 + uid AS pid, kind AS type, risk AS risk_level, confidence, is_elf, CAST(8192 AS BIGINT) AS size FROM reg
WHERE kind IS NOT NULL AND comm NOT IN ('ls', 'cat')""")
def memory_regions(spark, folder):
    allowed = A.load(spark, folder, "part").select(F.element_at(F.array(F.lit("ls"), F.lit("cat")), (F.col("p_partkey") % 2 + 1).cast("int")).alias("entry"))
    regions = memory.not_listed(samples.map_lines(spark, folder), allowed)
    return memory.linux_anomalies(regions).select("event_id", "pid", "type", "risk_level", "confidence", "is_elf", "size")


@query("memory_alerts", with_(RAW, MAPS) + """
SELECT 1000 + uid AS pid, count(*) AS anomalies, count(*) FILTER (WHERE risk = 'CRITICAL') AS critical FROM reg WHERE kind IS NOT NULL AND risk IN ('HIGH', 'CRITICAL') GROUP BY uid""")
def memory_alerts(spark, folder):
    found = memory.linux_anomalies(samples.map_lines(spark, folder))
    scans = memory.scan_results(found, ["event_id", "pid"]).withColumns({
        "ts_iso": F.lit("2024-01-01T00:00:00Z"), "host": F.lit("h"), "exe": F.lit(None).cast("string"), "reason": F.lit("Periodic Scan")})
    ev = memory.linux_scan_events(scans)
    return ev.groupBy(col("process.pid").cast("bigint").alias("pid")).agg(
        F.sum(F.size("memory.anomalies")).cast("bigint").alias("anomalies"),
        F.sum(F.size(F.filter("memory.anomalies", lambda a: a["risk_level"] == "CRITICAL"))).cast("bigint").alias("critical"))


@query("memory_region_rows", with_(RAW) + """
, r AS (SELECT *, ([4096, 4096, 8192])[k % 3 + 1] AS state, ([64, 32, 4, 64, 32])[k % 5 + 1] AS protect, k % 2 = 0 AS priv FROM raw)
SELECT type, risk_level, count(*) AS regions FROM (SELECT CASE WHEN protect = 64 THEN 'RWX_REGION' ELSE 'PRIVATE_EXEC' END AS type,
   CASE WHEN protect = 64 AND priv THEN 'CRITICAL' WHEN protect = 64 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level
  FROM r WHERE state = 4096 AND (protect = 64 OR (protect = 32 AND priv))) GROUP BY ALL""")
def memory_region_rows(spark, folder):
    return memory.windows_anomalies(samples.region_rows(spark, folder)).groupBy("type", "risk_level").agg(F.count(F.lit(1)).alias("regions"))


# ------------------------------------------------------------------ schema

@query("documents_round_trip", with_(EVENTS, LABELS) + "SELECT label, count(*) AS events FROM lab GROUP BY label")
def documents_round_trip(spark, folder):
    """Events written as JSON text and read back keep their labels."""
    docs = to_documents(A.unified_events(spark, folder))
    return L.with_labels(conform(fence(docs, ["value"]))).groupBy("label").agg(F.count(F.lit(1)).alias("events"))


@query("inferred_categories", with_(EVENTS) + """
SELECT category, CASE WHEN a1_type IS NOT NULL THEN 'memory' ELSE 'authentication' END AS inferred, count(*) AS events FROM ev GROUP BY ALL""")
def inferred_categories(spark, folder):
    ev = A.unified_events(spark, folder).withColumn("was", col("event.category"))
    blank = ev.withColumn("event", F.col("event").withField("category", F.lit("")))
    return blank.groupBy(F.col("was").alias("category"), store.infer_category().alias("inferred")).agg(F.count(F.lit(1)).alias("events"))


@query("parsed_times", "SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS at FROM events")
def parsed_times(spark, folder):
    """Nine fraction digits are cut to six."""
    a = A.activity(spark, folder)
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z"))
    return a.select(F.col("event_id").alias("seq"), iso(parse_iso(text)).alias("at"))


@query("decoded_commands", "SELECT lang, count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE strlen(text) >= 6 GROUP BY lang")
def decoded_commands(spark, folder):
    docs = A.load(spark, folder, "documents").where(F.octet_length("text") >= 6)
    plain = docs.withColumn("plain", decode_hex(F.hex(F.encode("text", "UTF-8"))))
    return plain.where(F.col("plain") == F.col("text")).groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("plain")).cast("bigint").alias("chars"))


# ------------------------------------------------------------------ behaviour

SIX_HOURS, HALF_DAY = 21600, 43200
CALLS = f"""
calls AS (SELECT id AS seq, ts, epoch_us(ts) AS us, 'host-' || (uid % 20) AS host, 1000 + uid AS pid, ({lst(A.SYSCALLS)})[k % 6 + 1] AS syscall, md5(CAST(CAST(floor(k / 34) AS INTEGER) AS VARCHAR)) AS signature FROM raw),
w1 AS (SELECT *,
   max(us) FILTER (WHERE syscall = 'ptrace') OVER b AS p0, max(us) FILTER (WHERE syscall = 'memfd_create') OVER b AS p1, max(us) FILTER (WHERE syscall = 'write') OVER b AS p2,
   max(us) FILTER (WHERE syscall = 'ptrace') OVER c AS s0, max(us) FILTER (WHERE syscall = 'memfd_create') OVER c AS s1
  FROM calls WINDOW b AS (PARTITION BY host, pid ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    c AS (PARTITION BY host, pid ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
w2 AS (SELECT *, max(CASE WHEN syscall = 'write' THEN p0 END) OVER c AS q0, max(CASE WHEN syscall = 'execve' THEN p1 END) OVER c AS q1, max(CASE WHEN syscall = 'mprotect' THEN p2 END) OVER c AS q2
  FROM w1 WINDOW c AS (PARTITION BY host, pid ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pat AS (SELECT *, CASE WHEN q0 > us - {SIX_HOURS}000000 THEN 'Ptrace Injection' WHEN q1 > us - {SIX_HOURS}000000 THEN 'Fileless Execution' WHEN q2 > us - {SIX_HOURS}000000 THEN 'Memory Tampering'
   WHEN s0 > us - {SIX_HOURS}000000 THEN 'Suspicious Ptrace' WHEN s1 > us - {SIX_HOURS}000000 THEN 'Memfd Creation' END AS reason FROM w2)
"""


@query("call_patterns", with_(RAW, CALLS) + "SELECT seq, COALESCE(reason, '-') AS reason FROM pat")
def call_patterns(spark, folder):
    """Calls per process are hours apart in the tables, so the horizon is six hours here."""
    return B.call_patterns(samples.syscalls(spark, folder), SIX_HOURS).select("seq", F.coalesce("reason", F.lit("-")).alias("reason"))


def _fold(source: str, keys: str, seconds: int) -> str:
    """Debounce as a recursive walk from each key's first row to the next row it accepts."""
    return f"""
, src AS ({source}), hop AS (SELECT a.*, (SELECT arg_min(b.seq, (b.us, b.seq)) FROM src b WHERE {keys} AND b.us >= a.us + {seconds}000000) AS nxt FROM src a),
firsts AS (SELECT a.seq FROM src a WHERE NOT EXISTS (SELECT 1 FROM src b WHERE {keys} AND (b.us, b.seq) < (a.us, a.seq))),
acc AS (SELECT seq FROM firsts UNION ALL SELECT hop.nxt FROM acc JOIN hop ON hop.seq = acc.seq WHERE hop.nxt IS NOT NULL)
"""


@query("scan_triggers", "WITH RECURSIVE " + (with_(RAW, CALLS) + _fold("SELECT seq, us, host, pid FROM pat WHERE reason IS NOT NULL AND syscall <> 'read'", "b.host = a.host AND b.pid = a.pid", HALF_DAY) +
       "SELECT seq FROM acc")[len("WITH "):])
def scan_triggers(spark, folder):
    return B.scan_triggers(samples.syscalls(spark, folder), SIX_HOURS, HALF_DAY).select("seq")


@query("distinct_alerts", "WITH RECURSIVE " + (with_(RAW, CALLS) + """
, runs AS (SELECT *, sum(chg) OVER (PARTITION BY host, pid ORDER BY us, seq) AS run FROM (
    SELECT *, CASE WHEN lag(signature) OVER (PARTITION BY host, pid ORDER BY us, seq) = signature THEN 0 ELSE 1 END AS chg FROM calls))
""" + _fold("SELECT seq, us, host, pid, run FROM runs", "b.host = a.host AND b.pid = a.pid AND b.run = a.run", HALF_DAY) + "SELECT seq FROM acc")[len("WITH "):])
def distinct_alerts(spark, folder):
    return B.distinct_alerts(samples.syscalls(spark, folder), ["host", "pid"], HALF_DAY).select("seq")
