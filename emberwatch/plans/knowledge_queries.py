"""Knowledge-base, attribution and indicator queries."""

from __future__ import annotations

from pyspark.sql import functions as F


from emberwatch.operators import graph as G
from emberwatch.operators import intel as I
from emberwatch.operators import knowledge as K
from emberwatch.operators import labels as L
from emberwatch.plans.case_report import case_reports
from emberwatch.plans.registry import query
from emberwatch.plans.twins import EVENTS, LABELS, lst, with_
from emberwatch.session import cut_lineage
from emberwatch.sources import profiles as P
from emberwatch.sources import stix
from emberwatch.sources import tables as A

BASE = f"""
tech0 AS (SELECT p_partkey AS pk, 'attack-pattern--' || p_partkey AS id, p_name AS name, p_type AS description, 'T' || (1000 + p_partkey) AS attack_id, p_size,
   ({lst(A.TACTIC_SLUGS)})[p_size % 14 + 1] AS t1, ({lst(A.TACTIC_SLUGS)})[(p_size * 3 + 1) % 14 + 1] AS t2,
   ({lst(A.PLATFORMS)})[CAST(p_partkey % 3 AS INT) + 1] AS platform, p_size % 5 = 0 AS sub, p_size % 17 = 0 AS revoked, p_size % 19 = 0 AS deprecated,
   DATE '2020-01-01' + CAST(p_partkey % 1000 AS INTEGER) AS created, DATE '2021-01-01' + CAST(p_partkey % 700 AS INTEGER) AS modified FROM part),
tech AS (SELECT * FROM tech0 WHERE NOT revoked AND NOT deprecated),
grp AS (SELECT s_suppkey AS sk, 'intrusion-set--' || s_suppkey AS id, s_name AS name, 'G' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS attack_id,
   'Actor ' || s_suppkey AS alias, 'Operates from nation ' || s_nationkey AS description, s_nationkey FROM supplier WHERE s_suppkey % 23 <> 0),
uses AS (SELECT DISTINCT l_suppkey AS sk, l_partkey AS pk FROM lineitem),
edge AS (SELECT g.name AS grp, g.attack_id AS group_id, t.attack_id AS technique_id, t.name AS technique, t.t1, t.t2
   FROM uses JOIN grp g USING (sk) JOIN tech t USING (pk)),
soft AS (SELECT c_custkey AS ck, CASE WHEN c_acctbal < 0 THEN 'malware' ELSE 'tool' END AS kind, c_name AS name FROM customer),
bought AS (SELECT l_suppkey AS sk, l_partkey AS pk, o_custkey AS ck FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""
KB = with_(BASE)


def _kb(spark, folder):
    return A.knowledge_objects(spark, folder), A.knowledge_relationships(spark, folder)


@query("kb_techniques", KB + """
SELECT attack_id, name, CASE WHEN t1 = t2 THEN t1 ELSE t1 || ',' || t2 END AS tactics, platform AS platforms, sub AS is_subtechnique FROM tech""")
def kb_techniques(spark, folder):
    return K.techniques(A.knowledge_objects(spark, folder)).select(
        "attack_id", "name", F.array_join("tactics", ",").alias("tactics"), F.array_join("platforms", ",").alias("platforms"), "is_subtechnique")


@query("kb_groups", KB + "SELECT attack_id, name, name || ',' || alias AS aliases, description FROM grp")
def kb_groups(spark, folder):
    return K.groups(A.knowledge_objects(spark, folder)).select("attack_id", "name", F.array_join("aliases", ",").alias("aliases"), "description")


@query("kb_group_techniques", KB + "SELECT grp AS \"group\", technique_id FROM edge")
def kb_group_techniques(spark, folder):
    return K.uses_edges(*_kb(spark, folder)).select("group", "technique_id")


@query("kb_find_group", KB + "SELECT name, attack_id FROM grp WHERE lower(alias) = 'actor 7' OR lower(name) = 'actor 7' OR lower(attack_id) = 'actor 7'")
def kb_find_group(spark, folder):
    return K.find_group(A.knowledge_objects(spark, folder), "ACTOR 7").select("name", "attack_id")


@query("kb_techniques_of_group", KB + "SELECT technique_id, technique FROM edge WHERE group_id = 'G000003'")
def kb_techniques_of_group(spark, folder):
    return K.techniques_of_group(*_kb(spark, folder), "g000003").select("technique_id", "technique")


@query("kb_groups_of_technique", KB + "SELECT DISTINCT grp AS \"group\", group_id FROM edge WHERE technique_id = 'T1105'")
def kb_groups_of_technique(spark, folder):
    return K.groups_of_technique(*_kb(spark, folder), "T1105")


@query("kb_technique_by_id", KB + "SELECT attack_id, name FROM tech WHERE attack_id = 'T1105'")
def kb_technique_by_id(spark, folder):
    return K.technique(A.knowledge_objects(spark, folder), "T1105").select("attack_id", "name")


@query("kb_techniques_of_tactic", KB + "SELECT attack_id FROM tech WHERE t1 = 'discovery' OR t2 = 'discovery'")
def kb_techniques_of_tactic(spark, folder):
    return K.techniques_of_tactic(A.knowledge_objects(spark, folder), "discovery").select("attack_id")


@query("kb_search_groups", KB + "SELECT name FROM grp WHERE contains(lower(name), 'nation 1') OR contains(lower(alias), 'nation 1') OR contains(lower(description), 'nation 1')")
def kb_search_groups(spark, folder):
    return K.search_groups(A.knowledge_objects(spark, folder), "Nation 1").select("name")


@query("kb_profiles", KB + """
SELECT g.name, g.attack_id, COALESCE(string_agg(DISTINCT technique_id, ',' ORDER BY technique_id), '') AS ttps FROM grp g LEFT JOIN edge ON edge.grp = g.name GROUP BY g.name, g.attack_id""")
def kb_profiles(spark, folder):
    return K.export_profiles(*_kb(spark, folder)).select("name", "attack_id", F.array_join("ttps", ",").alias("ttps"))


@query("kb_statistics", KB + """
SELECT (SELECT count(*) FROM grp) AS total_groups, (SELECT count(*) FROM tech) AS total_techniques, (SELECT count(*) FROM edge) AS total_relationships,
  (SELECT count(DISTINCT grp) FROM edge) AS groups_with_techniques, (SELECT count(*) FROM tech WHERE sub) AS subtechniques""")
def kb_statistics(spark, folder):
    return K.statistics(*_kb(spark, folder))


_MAPPED = """
SELECT 'tool_uses_technique' AS mapping, count(*) AS pairs, count(DISTINCT ck) AS objects FROM (SELECT DISTINCT ck, pk FROM bought JOIN soft USING (ck) WHERE kind = 'tool') JOIN tech0 USING (pk) WHERE NOT revoked
UNION ALL SELECT 'group_uses_malware', count(*), count(DISTINCT sk) FROM (SELECT DISTINCT sk, ck FROM bought JOIN soft USING (ck) WHERE kind = 'malware')
UNION ALL SELECT 'campaign_attributed_to_group', count(*), count(DISTINCT s_nationkey) FROM grp
UNION ALL SELECT 'mitigation_mitigates_technique', count(*), count(DISTINCT p_size % 5) FROM tech0 WHERE NOT revoked
UNION ALL SELECT 'subtechnique_of_technique', count(*), count(DISTINCT a.pk) FROM tech0 a JOIN tech0 b ON b.pk = a.pk - 1 WHERE a.sub AND NOT b.revoked
"""


@query("kb_mappings", KB + _MAPPED)
def kb_mappings(spark, folder):
    kb = _kb(spark, folder)
    out = None
    for name in ("tool_uses_technique", "group_uses_malware", "campaign_attributed_to_group", "mitigation_mitigates_technique", "subtechnique_of_technique"):
        part = K.mapping(*kb, name).agg(F.lit(name).alias("mapping"), F.count(F.lit(1)).alias("pairs"), F.count_distinct("object_id").alias("objects"))
        out = part if out is None else out.unionByName(part)
    return out


@query("kb_technique_mitigations", KB + """
SELECT id AS object_id, r_name AS related_name FROM tech0 JOIN region ON r_regionkey = p_size % 5""")
def kb_technique_mitigations(spark, folder):
    return K.mapping(*_kb(spark, folder), "mitigation_mitigates_technique", reverse=True).select("object_id", "related_name")


@query("kb_group_software", KB + """
SELECT group_ref, count(*) AS software FROM (SELECT DISTINCT 'intrusion-set--' || sk AS group_ref, ck FROM bought) GROUP BY group_ref""")
def kb_group_software(spark, folder):
    return K.software_of_groups(*_kb(spark, folder)).groupBy("group_ref").agg(F.count(F.lit(1)).alias("software"))


@query("kb_techniques_by_software", KB + """
, pairs AS (SELECT DISTINCT a.sk, b.pk FROM (SELECT DISTINCT sk, ck FROM bought) a JOIN (SELECT DISTINCT ck, pk FROM bought) b USING (ck))
SELECT 'intrusion-set--' || sk AS group_ref, count(*) AS techniques FROM pairs JOIN tech0 USING (pk) GROUP BY sk""")
def kb_techniques_by_software(spark, folder):
    return K.technique_counts_by_software(*_kb(spark, folder))


@query("kb_replaced", KB + """
SELECT a.id AS old_id, b.id AS new_id, b.name AS new_name FROM tech0 a JOIN tech0 b ON b.pk = a.pk + 1 WHERE a.revoked AND NOT b.revoked""")
def kb_replaced(spark, folder):
    return K.replaced_by(*_kb(spark, folder))


@query("kb_selected", KB + """
SELECT id FROM tech0 WHERE platform = 'Linux' AND created > DATE '2021-06-01' AND contains(lower(description), 'medium') AND NOT sub""")
def kb_selected(spark, folder):
    return K.select_objects(A.knowledge_objects(spark, folder), kind="attack-pattern", platform="Linux", created_after="2021-06-01",
                            content="medium", subtechniques=False).select("id")


@query("kb_modified_counts", KB + """
SELECT platform, count(*) AS objects FROM tech0 WHERE modified > DATE '2022-01-01' GROUP BY platform""")
def kb_modified_counts(spark, folder):
    o = K.select_objects(A.knowledge_objects(spark, folder), kind="attack-pattern", modified_after="2022-01-01")
    return o.groupBy(F.get("platforms", F.lit(0)).alias("platform")).agg(F.count(F.lit(1)).alias("objects"))


@query("kb_by_alias", KB + "SELECT id, name FROM grp WHERE alias = 'Actor 12'")
def kb_by_alias(spark, folder):
    return K.select_objects(stix.alive(A.knowledge_objects(spark, folder)), kind="intrusion-set", alias="Actor 12").select("id", "name")


@query("release_index", """
SELECT o_custkey AS collection, count(*) AS versions, strftime(min(o_orderdate), '%Y-%m-%d') AS created, strftime(max(o_orderdate), '%Y-%m-%d') AS modified,
  arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS name FROM orders GROUP BY o_custkey""")
def release_index(spark, folder):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return stix.release_index(A.release_versions(spark, folder)).select("collection", "versions", day("created"), day("modified"), "name")


@query("release_listing", """
SELECT o_custkey AS collection, o_orderkey AS version, strftime(o_orderdate, '%d %B %Y') AS released FROM orders""")
def release_listing(spark, folder):
    return stix.release_listing(A.release_versions(spark, folder))


# ------------------------------------------------------------------ attribution

CASES = f"""
cases AS (SELECT DISTINCT case_id, technique AS technique_id FROM ev WHERE technique IS NOT NULL),
gt AS (SELECT DISTINCT grp, technique_id FROM edge),
nc AS (SELECT case_id, count(*) AS n_case FROM cases GROUP BY case_id), ng AS (SELECT grp, count(*) AS n_group FROM gt GROUP BY grp),
ov AS (SELECT case_id, grp, count(*) AS shared, bool_or(technique_id IN ('T1071', 'T1041', 'T1567')) AS hot,
   string_agg(technique_id, ',' ORDER BY technique_id) AS matched FROM cases JOIN gt USING (technique_id) GROUP BY ALL),
sc AS (SELECT case_id, grp, matched, shared / (n_case + n_group - shared) AS j, shared / n_case AS r, hot FROM ov JOIN nc USING (case_id) JOIN ng USING (grp)),
fin AS (SELECT *, CASE WHEN hot THEN least((0.3::DOUBLE * j + 0.7::DOUBLE * r) * 1.1::DOUBLE, 1.0) ELSE 0.3::DOUBLE * j + 0.7::DOUBLE * r END AS s FROM sc),
scores AS (SELECT case_id, grp AS "group", round(s, 3) AS score, round(j, 3) AS jaccard, round(r, 3) AS recall, matched FROM fin WHERE s > 0.1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, "group") AS rank FROM scores)
"""
AT = with_(EVENTS, BASE, CASES)


def _cases(spark, folder):
    return I.case_techniques(A.unified_events(spark, folder), ["case_id"])


def _scores(spark, folder, best=None):
    edges = K.uses_edges(*_kb(spark, folder)).select("group", "technique_id").distinct()
    return I.overlap_scores(_cases(spark, folder), edges, ["case_id"], best)


@query("case_techniques", with_(EVENTS) + "SELECT DISTINCT case_id, technique AS technique_id FROM ev WHERE technique IS NOT NULL")
def case_techniques(spark, folder):
    return _cases(spark, folder)


@query("group_overlap_scores", AT + 'SELECT case_id, "group", score, jaccard, recall, matched AS matched_ttps FROM scores')
def group_overlap_scores(spark, folder):
    return _scores(spark, folder).withColumn("matched_ttps", F.array_join("matched_ttps", ","))


@query("top_groups", AT + 'SELECT case_id, rank, "group", score FROM ranked WHERE rank <= 5')
def top_groups(spark, folder):
    return I.top_groups(_scores(spark, folder, best=5), ["case_id"]).select("case_id", "rank", "group", "score")


@query("case_attribution", AT + """
SELECT c.case_id, CASE WHEN score >= 0.3 THEN "group" ELSE 'Unclassified' END AS suspected_group, COALESCE(score, 0) AS score
FROM (SELECT DISTINCT case_id FROM ev) c LEFT JOIN ranked ON ranked.case_id = c.case_id AND rank = 1""")
def case_attribution(spark, folder):
    cases = A.unified_events(spark, folder).select("case_id")
    return I.attribute(_scores(spark, folder, best=1), cases, ["case_id"]).select("case_id", "suspected_group", "score")


@query("attribution_alternatives", AT + 'SELECT case_id, rank, "group", score FROM ranked WHERE rank BETWEEN 2 AND 4 AND score >= 0.3')
def attribution_alternatives(spark, folder):
    return I.alternatives(_scores(spark, folder, best=4), ["case_id"])


_LABEL_OF = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in I.TACTIC_LABELS.items()) + " END"


@query("group_playbooks", KB + f"""
, long AS (SELECT grp, technique_id, 0 AS p, {_LABEL_OF.format('t1')} AS label FROM edge UNION ALL SELECT grp, technique_id, 1, {_LABEL_OF.format('t2')} FROM edge WHERE t1 <> t2),
firsts AS (SELECT grp, label, min((technique_id, p)) AS o FROM long GROUP BY grp, label)
SELECT grp AS "group", string_agg(label, '->' ORDER BY o) AS attack_sequence, sha256(string_agg(label, '->' ORDER BY o)) AS fingerprint FROM firsts GROUP BY grp""")
def group_playbooks(spark, folder):
    return I.playbooks(K.uses_edges(*_kb(spark, folder))).select(
        "group", F.array_join("attack_sequence", "->").alias("attack_sequence"), L.fingerprint(F.col("attack_sequence")).alias("fingerprint"))


def _sequences(spark, folder):
    return cut_lineage(L.label_sequence(L.with_labels(A.unified_events(spark, folder)), ["case_id"]))


def _profiles(spark, folder):
    return cut_lineage(I.playbooks(K.uses_edges(*_kb(spark, folder))))


@query("playbook_similarity")
def playbook_similarity(spark, folder):
    """Sequence ratio of every case to every playbook with a label in common."""
    return I.sequence_similarity(_sequences(spark, folder), _profiles(spark, folder), ["case_id"])


@query("layered_attribution")
def layered_attribution(spark, folder):
    seqs = _sequences(spark, folder)
    local = I.sequence_similarity(seqs, P.local_playbooks(spark).select(F.col("name").alias("group"), "attack_sequence"), ["case_id"])
    by_label = I.sequence_similarity(seqs, _profiles(spark, folder), ["case_id"], best=True)
    return I.layered_attribution(seqs.select("case_id"), local, _scores(spark, folder, best=1), by_label, ["case_id"])


@query("attribution_explained")
def attribution_explained(spark, folder):
    """Steps of each case's best playbook that were seen, missing or additional."""
    seqs, books = _sequences(spark, folder), _profiles(spark, folder)
    best = I.top_groups(I.sequence_similarity(seqs, books, ["case_id"], best=True), ["case_id"], 1).select("case_id", "group")
    out = I.explain(best.join(seqs, "case_id").join(books, "group"))
    return out.select("case_id", "group", F.round("total_similarity", 3).alias("total_similarity"), F.size("matched_steps").alias("matched"),
                      F.array_join("missing_steps", ",").alias("missing"), F.array_join("extra_steps", ",").alias("extra"), "recommendation")


@query("merged_profiles", KB + """
SELECT name, 'knowledge base' AS origin FROM grp
UNION ALL SELECT name, 'local' FROM (VALUES ('APT-WebShell-Demo'), ('APT-SSH-BruteForce-Demo'), ('APT-Simulated-Group5')) t(name)
UNION ALL SELECT name, 'built-in' FROM (VALUES ('APT28'), ('APT29')) t(name)""")
def merged_profiles(spark, folder):
    real = K.groups(A.knowledge_objects(spark, folder)).select("name", F.lit("knowledge base").alias("origin"))
    builtin = P.builtin_playbooks(spark).select("name", F.lit("built-in").alias("origin"))
    local = P.local_playbooks(spark).select("name", F.lit("local").alias("origin"))
    return I.merged_profiles(real, builtin, local)


@query("enriched_profiles", KB + """
SELECT s_name AS name, attack_id AS official_id, 'https://attack.mitre.org/groups/' || attack_id AS url,
  array_to_string(list_sort(list_distinct([CASE WHEN g.name IS NULL THEN NULL ELSE g.name END, g.alias, 'alias of ' || s_suppkey])), '|') AS aliases
FROM supplier LEFT JOIN grp g ON g.sk = s_suppkey""")
def enriched_profiles(spark, folder):
    base = A.load(spark, folder, "supplier").select(
        F.concat(F.lit("Actor "), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_name"),
        F.array(F.concat(F.lit("alias of "), F.col("s_suppkey").cast("string"))).alias("aliases"))
    base = base.withColumn("name", F.when(F.regexp_extract("name", r"\d+", 0).cast("int") % 23 == 0, F.col("s_name")).otherwise(F.col("name"))).drop("s_name")
    out = I.enrich_profiles(base, K.group_names(A.knowledge_objects(spark, folder)), "https://attack.mitre.org/groups/")
    return out.select("name", "official_id", "url", F.array_join("aliases", "|").alias("aliases"))


# ------------------------------------------------------------------ indicators

IOCS = """
loc AS (SELECT '10.0.' || (s_suppkey % 8) || '.' || (s_suppkey % 250) AS ioc, max(s_suppkey) AS k FROM supplier GROUP BY 1),
feed AS (SELECT '10.0.' || (c_custkey % 8) || '.' || (c_custkey % 250) AS ioc, max(c_custkey) AS k FROM customer GROUP BY 1),
seen AS (SELECT DISTINCT src_ip AS ioc FROM ev WHERE category NOT IN ('file') UNION SELECT DISTINCT dst_ip FROM ev WHERE category = 'network' UNION SELECT DISTINCT host_ip FROM ev)
"""


@query("abuse_entries", with_(IOCS.split("seen AS")[0].rstrip().rstrip(",")) + """
SELECT f.ioc, CAST(k % 101 AS INTEGER) AS risk_score, array_to_string([t FOR t IN [CASE WHEN k % 101 >= 80 THEN 'High Risk' END, CASE WHEN k % 101 >= 50 THEN 'Malicious' END,
  CASE WHEN k % 40 > 10 THEN 'Frequently Reported' END, 'ISP:' || c_mktsegment] IF t IS NOT NULL], '|') AS tags, CAST(c_nationkey AS VARCHAR) AS geo
FROM feed f JOIN customer ON c_custkey = k""")
def abuse_entries(spark, folder):
    return I.abuse_entries(A.abuse_feed(spark, folder)).select("ioc", "risk_score", F.array_join("tags", "|").alias("tags"), "geo")


@query("detection_entries", """
SELECT CASE WHEN p_partkey % 2 = 0 THEN 'domain' ELSE 'ip' END AS ioc_type,
  CAST(least(100, floor((p_partkey % 23) / greatest(p_partkey % 23 + p_partkey % 61 + p_partkey % 5 + p_partkey % 7, 1) * 100 * 2)) AS INTEGER) AS risk_score,
  CASE WHEN p_partkey % 23 > 10 THEN 'Malicious|High Risk' WHEN p_partkey % 23 > 5 THEN 'Malicious' ELSE '' END AS tags,
  CASE WHEN p_partkey % 3 = 0 THEN 'Unknown' ELSE 'DE' END AS geo, count(*) AS entries FROM part GROUP BY ALL""")
def detection_entries(spark, folder):
    return I.detection_entries(A.detection_feed(spark, folder)).groupBy(
        "ioc_type", "risk_score", F.array_join("tags", "|").alias("tags"), "geo").agg(F.count(F.lit(1)).alias("entries"))


@query("node_indicators")
def node_indicators(spark, folder):
    """Indicators named by graph nodes; which node keeps which address depends on first mention, so compare by rows."""
    nodes, _ = G.build_graph(A.unified_events(spark, folder))
    return I.node_iocs(nodes)


@query("enriched_indicators", with_(EVENTS, IOCS) + """
SELECT ioc, CAST(COALESCE(loc.k, feed.k) % 101 AS INTEGER) AS risk_score, CASE WHEN loc.k IS NOT NULL THEN 'local_custom' ELSE 'AbuseIPDB' END AS source,
  COALESCE(loc.k, feed.k) % 101 >= 70 AS is_malicious
FROM (SELECT DISTINCT src_ip AS ioc FROM ev UNION SELECT dst_ip FROM ev WHERE dst_ip IS NOT NULL) s LEFT JOIN loc USING (ioc) LEFT JOIN feed USING (ioc)
WHERE loc.k IS NOT NULL OR feed.k IS NOT NULL""")
def enriched_indicators(spark, folder):
    ev = A.unified_events(spark, folder)
    seen = ev.select(F.explode(F.array_compact(F.array("source.ip", "destination.ip"))).alias("ioc")).distinct()
    return I.enrich(seen, A.local_indicators(spark, folder), I.abuse_entries(A.abuse_feed(spark, folder))).select("ioc", "risk_score", "source", "is_malicious")


@query("case_reports", with_(EVENTS, BASE, CASES, LABELS) + """
, sig AS (SELECT case_id, array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE label <> 'UNKNOWN')), ' -> ') AS signature, count(*) AS events FROM lab GROUP BY case_id),
tt AS (SELECT case_id, string_agg(technique_id, ',' ORDER BY technique_id) AS ttps FROM cases GROUP BY case_id)
SELECT sig.case_id, events, signature, COALESCE(ttps, '') AS ttps, CASE WHEN score >= 0.3 THEN "group" ELSE 'Unclassified' END AS suspected_group, COALESCE(score, 0) AS score
FROM sig LEFT JOIN tt USING (case_id) LEFT JOIN ranked ON ranked.case_id = sig.case_id AND rank = 1""")
def case_report_query(spark, folder):
    edges = K.uses_edges(*_kb(spark, folder)).select("group", "technique_id").distinct()
    out = case_reports(A.unified_events(spark, folder), edges, ["case_id"], graph=False)
    return out.select("case_id", "events", "signature", F.array_join("ttps", ",").alias("ttps"), "suspected_group", "score")


@query("case_graph_sizes")
def case_graph_sizes(spark, folder):
    """Nodes, edges and indicators of each case's own graph."""
    edges = K.uses_edges(*_kb(spark, folder)).select("group", "technique_id").distinct()
    out = case_reports(A.unified_events(spark, folder), edges, ["case_id"], indicators=[A.local_indicators(spark, folder)])
    return out.select("case_id", "events", "nodes", "edges", "iocs", "malicious_iocs")
