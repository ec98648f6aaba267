"""Provenance graph, correlation and expansion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.functions.columns import col
from emberwatch.operators import correlate as C
from emberwatch.operators import graph as G
from emberwatch.operators import knowledge as K
from emberwatch.operators import scoring as S
from emberwatch.plans.case_report import reconstruct
from emberwatch.plans.registry import query
from emberwatch.plans.twins import EVENTS, LABELS, SCORES, SEEDS, with_
from emberwatch.sources.tables import knowledge_objects, knowledge_relationships, local_indicators, unified_events

_START = "iso_ts"
PARTS = """
parts AS (SELECT *,
  md5('host|' || host) AS host_id,
  CASE WHEN pid IS NOT NULL THEN md5(host || '|' || pid || '|' || COALESCE(exe, '') || '|' || iso_ts) END AS process_id,
  CASE category
    WHEN 'process' THEN md5(host || '|' || pid || '|' || COALESCE(exe, '') || '|' || iso_ts)
    WHEN 'file' THEN md5(host || '|' || path || '|' || iso_ts)
    WHEN 'network' THEN md5(host || '|' || src_ip || '|' || src_port || '|' || dst_ip || '|' || dst_port || '|' || proto || '|' || iso_ts)
    WHEN 'authentication' THEN md5(host || '|' || user_name || '|' || src_ip || '|' || outcome || '|' || iso_ts)
    ELSE md5(eid) END AS event_node,
  CASE WHEN category = 'file' THEN md5('file|' || host || '|' || path) END AS file_id,
  CASE WHEN category NOT IN ('authentication', 'file') THEN
    md5('network|' || host || '|' || COALESCE(dst_ip, '') || '|' || COALESCE(CAST(dst_port AS VARCHAR), '') || '|' || COALESCE(proto, '')) END AS network_id,
  CASE WHEN category NOT IN ('network', 'file') THEN md5('auth|' || host || '|' || user_name || '|' || src_ip || '|' || outcome) END AS auth_id
  FROM lab),
parts2 AS (SELECT *, CASE WHEN category = 'memory' THEN md5('anomaly|' || iso_ts || '|' || event_node) END AS anomaly_id FROM parts)
"""
GRAPH = """
mention AS (
  SELECT host_id AS id, 'host' AS type, host AS label, '' AS semantic, seq * 10 AS o FROM parts2
  UNION ALL SELECT anomaly_id, 'memory_anomaly', 'Memory Anomaly', '', seq * 10 + 1 FROM parts2 WHERE anomaly_id IS NOT NULL
  UNION ALL SELECT process_id, 'process', CASE WHEN exe IS NULL THEN 'process' ELSE regexp_extract(exe, '[^/]*$') END || ' (PID:' || pid || ')',
     CASE WHEN category = 'process' THEN lab_ ELSE '' END, seq * 10 + 2 FROM (SELECT *, label AS lab_ FROM parts2) WHERE process_id IS NOT NULL
  UNION ALL SELECT file_id, 'file', regexp_extract(path, '[^/]*$'), label, seq * 10 + 3 FROM parts2 WHERE file_id IS NOT NULL
  UNION ALL SELECT network_id, 'network', CASE WHEN dst_ip IS NULL THEN COALESCE(proto, 'network') ELSE proto || ':' || dst_ip || ':' || dst_port END, label, seq * 10 + 4
     FROM parts2 WHERE network_id IS NOT NULL
  UNION ALL SELECT auth_id, 'authentication', user_name || '@' || src_ip, label, seq * 10 + 5 FROM parts2 WHERE auth_id IS NOT NULL),
known AS (SELECT id, arg_min(type, o) AS type, arg_min(label, o) AS label, arg_min(semantic, o) AS semantic FROM mention GROUP BY id),
proc AS (SELECT host, pid, arg_min(process_id, seq) AS parent FROM parts2 WHERE process_id IS NOT NULL GROUP BY host, pid),
link AS (SELECT l.host, l.ppid, l.process_id, l.iso_ts, l.seq,
   COALESCE(parent, md5(l.host || '|' || l.ppid || '||unknown')) AS parent_id, parent IS NULL AS missing
  FROM parts2 l LEFT JOIN proc ON proc.host = l.host AND proc.pid = l.ppid WHERE l.process_id IS NOT NULL),
node AS (SELECT id, type, label, semantic FROM known
  UNION ALL SELECT parent_id, 'process', 'parent (PID:' || arg_min(ppid, seq) || ')', '' FROM link
    WHERE missing AND parent_id NOT IN (SELECT id FROM known) GROUP BY parent_id),
edge0 AS (
  SELECT event_node AS source, anomaly_id AS target, 'triggered_anomaly' AS relation, iso_ts, seq * 10 AS o FROM parts2 WHERE anomaly_id IS NOT NULL
  UNION ALL SELECT COALESCE(process_id, host_id), file_id, CASE WHEN process_id IS NULL THEN 'host_file' WHEN action = 'read' THEN 'read'
     WHEN action IN ('create', 'rename') THEN 'write' WHEN action = 'delete' THEN 'delete' ELSE 'file_op' END, iso_ts, seq * 10 + 1 FROM parts2 WHERE file_id IS NOT NULL
  UNION ALL SELECT COALESCE(process_id, host_id), network_id, CASE WHEN process_id IS NULL THEN 'host_network' WHEN direction = 'outbound' THEN 'connect_outbound'
     WHEN direction = 'inbound' THEN 'connect_inbound' ELSE 'connect' END, iso_ts, seq * 10 + 2 FROM parts2 WHERE network_id IS NOT NULL
  UNION ALL SELECT COALESCE(process_id, host_id), auth_id, CASE WHEN process_id IS NULL THEN 'host_auth' ELSE 'auth' END, iso_ts, seq * 10 + 3 FROM parts2 WHERE auth_id IS NOT NULL
  UNION ALL SELECT parent_id, process_id, 'spawned', iso_ts, seq * 10 + 9 FROM link),
edge AS (SELECT source, target, relation, arg_min(iso_ts, o) AS timestamp FROM edge0 GROUP BY ALL)
"""
GR = with_(EVENTS, LABELS, PARTS, GRAPH)


def _graph(spark, folder, **kw):
    return G.build_graph(unified_events(spark, folder), **kw)


@query("graph_nodes", GR + "SELECT id, type, label, semantic FROM node")
def graph_nodes(spark, folder):
    nodes, _ = _graph(spark, folder)
    return nodes.select("id", "type", "label", "semantic")


@query("graph_edges", GR + "SELECT source, target, relation, timestamp FROM edge")
def graph_edges(spark, folder):
    _, edges = _graph(spark, folder)
    return edges.select("source", "target", "relation", "timestamp")


@query("event_node_ids", with_(EVENTS, LABELS, PARTS) + "SELECT seq, event_node AS node_id FROM parts")
def event_node_ids(spark, folder):
    return G.with_start_times(unified_events(spark, folder), None).select("seq", G.event_node_id().alias("node_id"))


@query("process_start_times", with_(EVENTS) + """
SELECT host, pid, arg_max(iso_ts, seq) AS start_time FROM ev WHERE category = 'process' GROUP BY host, pid""")
def process_start_times(spark, folder):
    return G.pid_table(_pids(spark, folder))


def _pids(spark, folder):
    ev = unified_events(spark, folder).where(col("event.category") == "process")
    return ev.select("seq", col("host.name").alias("host"), col("process.pid").alias("pid"), F.col("`@timestamp`").alias("start_time"))


@query("graph_with_start_times", with_(EVENTS) + """
, st AS (SELECT host, pid, arg_max(iso_ts, seq) AS start_time FROM ev WHERE category = 'process' GROUP BY host, pid),
p AS (SELECT ev.host, md5(ev.host || '|' || ev.pid || '|' || COALESCE(exe, '') || '|' || COALESCE(start_time, iso_ts)) AS id
  FROM ev LEFT JOIN st ON st.host = ev.host AND st.pid = ev.pid WHERE ev.pid IS NOT NULL)
SELECT host, count(DISTINCT id) AS processes FROM p GROUP BY host""")
def graph_with_start_times(spark, folder):
    """Process nodes when start times come from the pid table."""
    parts = G.event_parts(unified_events(spark, folder), G.pid_table(_pids(spark, folder)))
    return parts.where(F.col("process_id").isNotNull()).groupBy("host").agg(F.count_distinct("process_id").alias("processes"))


@query("attack_chain_steps", GR + """
SELECT COALESCE(s.type, 'unknown') AS source_type, relation, COALESCE(t.type, 'unknown') AS target_type, count(*) AS edges, min(timestamp) AS first_seen
FROM edge LEFT JOIN node s ON s.id = source LEFT JOIN node t ON t.id = target GROUP BY ALL""")
def attack_chain_steps(spark, folder):
    return G.chain(*_graph(spark, folder)).groupBy("source_type", "relation", "target_type").agg(
        F.count(F.lit(1)).alias("edges"), F.min("timestamp").alias("first_seen"))


@query("event_entities", with_(EVENTS) + """
SELECT type, role, count(*) AS mentions, count(DISTINCT value) AS entities FROM (
  SELECT 'host' AS type, 'target' AS role, host AS value FROM ev UNION ALL SELECT 'ip', 'source', src_ip FROM ev
  UNION ALL SELECT 'ip', 'destination', dst_ip FROM ev UNION ALL SELECT 'user', 'subject', user_name FROM ev
  UNION ALL SELECT 'process', 'subject', proc FROM ev UNION ALL SELECT 'file', 'object', path FROM ev) WHERE value IS NOT NULL GROUP BY ALL""")
def event_entities(spark, folder):
    return G.entities(unified_events(spark, folder)).groupBy("type", "role").agg(
        F.count(F.lit(1)).alias("mentions"), F.count_distinct("entity_id").alias("entities"))


# The tables hold about one event in four minutes, so the correlation window is an hour here.
HOUR = 3600
SHARED = "(contains({0}path, '/tmp/') OR contains({0}path, '/dev/shm/') OR contains({0}path, '/var/www/'))"
_BASE = "regexp_extract({0}path, '[^/]*$')"
PAIR = f"""
  e.host = a.host AND abs(epoch_us(e.ts) - epoch_us(a.ts)) <= 3600000000 AND ({{cond}})
"""
_FILE = (f"({SHARED.format('a.')} AND length({_BASE.format('a.')}) > 3 AND {_BASE.format('e.')} = {_BASE.format('a.')})"
         f" OR (NOT {SHARED.format('a.')} AND (e.path = a.path OR e.file_name = {_BASE.format('a.')}))")
REASONS = {"child": "e.ppid = a.pid", "parent": "e.pid = a.ppid", "file": _FILE, "source_ip": "e.src_ip = a.src_ip"}


@query("related_events", with_(EVENTS, SCORES, SEEDS) + ", rel AS (" + " UNION ALL ".join(
    f"SELECT a.seq AS anchor_seq, e.seq, '{r}' AS reason FROM seed a JOIN ev e ON {PAIR.format(cond=c)}" for r, c in REASONS.items()) +
    ") SELECT anchor_seq, seq, reason FROM rel")
def related_events(spark, folder):
    ev = unified_events(spark, folder)
    seeds = C.slim(S.seeds(ev))
    return C.related(seeds, C.slim(ev), HOUR).select("anchor_seq", "seq", "reason")


@query("related_event_counts", with_(EVENTS) + ", rel AS (" + " UNION ALL ".join(
    f"SELECT a.seq AS anchor_seq, '{r}' AS reason, count(*) AS events FROM ev a JOIN ev e ON {PAIR.format(cond=c)} WHERE a.det_severity = 'critical' GROUP BY a.seq"
    for r, c in REASONS.items()) + ") SELECT reason, count(*) AS anchors, CAST(sum(events) AS BIGINT) AS events FROM rel GROUP BY reason")
def related_event_counts(spark, folder):
    """All critical events as anchors, counted without a pair."""
    ev = unified_events(spark, folder)
    anchors = C.slim(ev.where(col("detection.severity") == "critical"))
    counts = C.count_related(anchors, C.slim(ev), HOUR)
    return counts.groupBy("reason").agg(F.count(F.lit(1)).alias("anchors"), F.sum("events").cast("bigint").alias("events"))


REACH = f"""
pick AS (SELECT seq FROM seed ORDER BY confidence DESC, ts DESC, seq DESC LIMIT 1),
rel AS (SELECT DISTINCT a.seq AS a, e.seq AS b FROM ev a JOIN ev e ON {PAIR.format(cond=' OR '.join('(' + c + ')' for c in REASONS.values()))}),
walk(seq, depth) USING KEY (seq) AS (
  SELECT seq, 0 FROM pick
  UNION (SELECT b, min(depth) + 1 FROM walk JOIN rel ON rel.a = walk.seq WHERE b NOT IN (SELECT seq FROM recurring.walk) GROUP BY b))
"""


@query("attack_path", "WITH RECURSIVE " + with_(EVENTS, SCORES, SEEDS, REACH)[len("WITH "):] + "SELECT seq, depth FROM walk")
def attack_path(spark, folder):
    """Everything reachable from the best seed, to the fixpoint on both sides."""
    ev = unified_events(spark, folder)
    slim = C.slim(ev)
    seed = C.slim(S.best_seed(S.seeds(ev)))
    return C.expand(seed, slim, HOUR).select("seq", "depth")


@query("attack_reconstruction", "WITH RECURSIVE " + with_(EVENTS, SCORES, SEEDS, REACH)[len("WITH "):] + """
SELECT 'event' AS part, category AS name, count(*) AS n FROM walk JOIN ev USING (seq) GROUP BY category
UNION ALL SELECT 'technique', technique, count(*) FROM walk JOIN ev USING (seq) WHERE technique IS NOT NULL GROUP BY technique""")
def attack_reconstruction(spark, folder):
    """The facade over one seed: its events by category and the techniques they name."""
    ev = unified_events(spark, folder)
    groups = K.uses_edges(knowledge_objects(spark, folder), knowledge_relationships(spark, folder)).select("group", "technique_id").distinct()
    found = reconstruct(S.best_seed(S.seeds(ev)), ev, groups, [local_indicators(spark, folder)], HOUR)
    n = F.count(F.lit(1))
    by_category = found["events"].groupBy(col("event.category").alias("name")).agg(n.alias("n")).select(F.lit("event").alias("part"), "name", "n")
    named = found["events"].where(col("threat.technique.id").isNotNull()).groupBy(col("threat.technique.id").alias("name")).agg(n.alias("n"))
    listed = found["techniques"].select(F.col("technique_id").alias("name"))
    return by_category.unionByName(named.join(listed, "name", "left_semi").select(F.lit("technique").alias("part"), "name", "n"))
