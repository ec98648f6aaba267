"""Graph construction, correlation and expansion on small cases, checked against plain Python."""

import hashlib
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from emberwatch.operators import correlate as C
from emberwatch.operators import graph as G

BASE = datetime(2026, 1, 15, 10, 0, 0)


def at(s):
    return (BASE + timedelta(seconds=s)).isoformat(timespec="microseconds") + "Z"


def md5(*parts):
    return hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()


def test_pid_reuse_gives_two_processes(events):
    df = events(*[{"@timestamp": at(i), "event": {"id": f"e{i}", "category": "process"}, "host": {"name": "h"},
                   "process": {"pid": 10, "executable": "/bin/a", "start_time": at(i)}} for i in (0, 5)])
    nodes, _ = G.build_graph(df)
    assert nodes.where("type = 'process'").count() == 2 and nodes.where("type = 'host'").count() == 1


def test_parent_is_reused_or_placed(events):
    df = events(
        {"@timestamp": at(0), "event": {"id": "a", "category": "process"}, "host": {"name": "h"}, "process": {"pid": 1, "executable": "/bin/p"}},
        {"@timestamp": at(1), "event": {"id": "b", "category": "process"}, "host": {"name": "h"}, "process": {"pid": 2, "executable": "/bin/c", "parent": {"pid": 1}}},
        {"@timestamp": at(2), "event": {"id": "c", "category": "process"}, "host": {"name": "h"}, "process": {"pid": 3, "executable": "/bin/d", "parent": {"pid": 99}}})
    nodes, edges = G.build_graph(df)
    spawned = {(r.source, r.target) for r in edges.where("relation = 'spawned'").collect()}
    parent, ghost = md5("h", 1, "/bin/p", at(0)), md5("h", 99, "", "unknown")
    assert spawned == {(parent, md5("h", 2, "/bin/c", at(1))), (ghost, md5("h", 3, "/bin/d", at(2)))}
    labels = {r.id: r.label for r in nodes.collect()}
    assert labels[ghost] == "parent (PID:99)" and labels[parent] == "p (PID:1)"


def test_one_placeholder_per_unseen_parent(events):
    df = events(*[{"@timestamp": at(i), "event": {"id": f"e{i}", "category": "process"}, "host": {"name": "h"},
                   "process": {"pid": 10 + i, "executable": "/bin/a", "parent": {"pid": 5, "executable": exe}}} for i, exe in enumerate(("/bin/x", "/bin/y"))])
    nodes, edges = G.build_graph(df)
    ghost = md5("h", 5, "/bin/x", "unknown")
    assert {r.source for r in edges.where("relation = 'spawned'").collect()} == {ghost}
    assert nodes.where("type = 'process'").count() == 3 and nodes.where(F.col("id") == ghost).count() == 1


def test_two_operations_on_one_file(events):
    doc = lambda i, a: {"@timestamp": at(i), "event": {"id": a, "category": "file", "action": a}, "host": {"name": "h"}, "file": {"path": "/srv/x"}}
    nodes, edges = G.build_graph(events(doc(0, "write"), doc(1, "read")))
    assert nodes.where("type = 'file'").count() == 1
    assert [(r.relation, r.timestamp) for r in edges.collect()] == [("host_file", at(0))]


def test_memory_anomaly_edge(events):
    df = events({"@timestamp": at(0), "event": {"id": "m", "category": "memory"}, "host": {"name": "h"}, "process": {"pid": 7},
                 "memory": {"anomalies": [{"type": "MEMFD_EXEC", "risk_level": "CRITICAL"}]}})
    nodes, edges = G.build_graph(df)
    row = nodes.where("type = 'memory_anomaly'").first()
    assert row.severity == 9 and row.technique == "T1055"
    source = hashlib.md5(b"m").hexdigest()
    assert edges.where("relation = 'triggered_anomaly'").first().source == source and row.id == md5("anomaly", at(0), source)


def test_pid_table_last_write_wins(spark):
    df = spark.createDataFrame([(0, "h", 1, "a"), (1, "h", 1, "b"), (2, "h", 2, "c")], "seq long, host string, pid int, start_time string")
    assert {(r.pid, r.start_time) for r in G.pid_table(df).collect()} == {(1, "b"), (2, "c")}


def _random_events(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        d = {"@timestamp": at(rnd.randrange(0, 400)), "event": {"id": f"e{i}", "category": "process"}, "host": {"name": f"h{rnd.randrange(2)}"},
             "process": {"pid": rnd.randrange(1, 12), "parent": {"pid": rnd.randrange(0, 12)}}}
        if rnd.random() < 0.4:
            d["file"] = {"path": rnd.choice(["/tmp/abcd", "/tmp/ab", "/var/www/abcd", "/srv/abcd", "/srv/q"])}
            d["file"]["name"] = d["file"]["path"].split("/")[-1]
        if rnd.random() < 0.3:
            d["source"] = {"ip": rnd.choice(["1.1.1.1", "2.2.2.2"])}
        out.append(d)
    return out


def _brute(a, e, window):
    t = lambda d: datetime.fromisoformat(d["@timestamp"].rstrip("Z"))
    if a["host"]["name"] != e["host"]["name"] or abs((t(a) - t(e)).total_seconds()) > window:
        return False
    pa, pe = a["process"], e["process"]
    if pe["parent"]["pid"] and pe["parent"]["pid"] == pa["pid"] or pa["parent"]["pid"] and pe["pid"] == pa["parent"]["pid"]:
        return True
    fa, fe = a.get("file", {}), e.get("file", {})
    path, base = fa.get("path", ""), fa.get("path", "").split("/")[-1]
    if path and any(x in path for x in ("/tmp/", "/dev/shm/", "/var/www/")):
        if len(base) > 3 and fe.get("path", "").split("/")[-1] == base:
            return True
    elif path and fe and (fe["path"] == path or fe["name"] == base):
        return True
    return bool(a.get("source")) and a.get("source") == e.get("source")


def test_related_matches_brute_force(events):
    docs = _random_events(80, 7)
    slim = C.slim(events(*docs))
    want = {(i, j) for i, a in enumerate(docs) for j, e in enumerate(docs) if _brute(a, e, 30)}
    assert {(r.anchor_seq, r.seq) for r in C.related(slim, slim, 30).collect()} == want


def test_expansion_matches_brute_force(events):
    docs = _random_events(60, 3)
    slim = C.slim(events(*docs))
    depth, frontier = {0: 0}, {0}
    for d in range(1, 11):
        frontier = {j for i in frontier for j in range(len(docs)) if j not in depth and _brute(docs[i], docs[j], 20)}
        depth.update({j: d for j in frontier})
        if not frontier:
            break
    got = {r.seq: r.depth for r in C.expand(slim.where(F.col("seq") == 0), slim, 20).collect()}
    assert got == depth


def test_attack_path_goes_to_the_end_of_a_long_chain(events, spark, monkeypatch):
    """Fourteen hops, 50 minutes apart; only neighbours are within the hour."""
    from emberwatch.plans import graph_queries as Q

    docs = [{"@timestamp": at(3000 * i), "event": {"id": f"e{i}", "category": "process"}, "host": {"name": "h"},
             "process": {"pid": 100 + i, "parent": {"pid": 99 + i}}} for i in range(15)]
    monkeypatch.setattr(Q, "unified_events", lambda spark, folder: events(*docs))
    monkeypatch.setattr(Q.S, "seeds", lambda ev: ev)
    monkeypatch.setattr(Q.S, "best_seed", lambda seeds: seeds.where("seq = 0"))
    depth, frontier = {0: 0}, {0}
    for d in range(1, 20):
        frontier = {j for i in frontier for j in range(len(docs)) if j not in depth and _brute(docs[i], docs[j], Q.HOUR)}
        depth.update({j: d for j in frontier})
    assert max(depth.values()) == 14
    assert {r.seq: r.depth for r in Q.attack_path(spark, "").collect()} == depth


def test_counts_without_pairs_equal_the_pairs(events):
    docs = _random_events(120, 11) + _random_events(40, 12)
    for i, d in enumerate(docs):
        d["event"]["id"] = f"e{i}"
    docs[5]["file"] = {"path": "/srv/abcd", "name": "other"}
    docs[6]["file"] = {"path": "/srv/abcd"}
    slim = C.slim(events(*docs))
    want = {(r.anchor_seq, r.reason): r.events for r in C.related_counts(C.related(slim, slim, 30)).collect()}
    for chunk in (7, 3600):  # slices shorter and longer than the window
        assert {(r.anchor_seq, r.reason): r.events for r in C.count_related(slim, slim, 30, chunk).collect()} == want
    plan = C.count_related(slim, slim, 30)._jdf.queryExecution().optimizedPlan().toString()
    assert "anchor_ts" not in plan and len({k for _, k in want}) == 4
    assert C.count_related(slim.limit(0), slim, 30).count() == 0 and C.count_related(slim, slim.limit(0), 30).count() == 0


def test_expansion_of_fifty_hops(spark, events):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    docs = [{"@timestamp": at(20 * i), "event": {"id": f"e{i}", "category": "process"}, "host": {"name": "h"},
             "process": {"pid": 100 + i, "parent": {"pid": 99 + i}}} for i in range(51)]
    slim = C.slim(events(*docs)).coalesce(1)
    got = {r.seq: r.depth for r in C.expand(slim.where(F.col("seq") == 0), slim, 30).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: i for i in range(51)}


def test_technique_sets_equal_the_pairs(spark):
    import random

    from emberwatch.operators import knowledge as K

    rnd = random.Random(4)
    objects = spark.createDataFrame([(f"t{i}", "attack-pattern", f"T{i}") for i in range(90)], "id string, type string, attack_id string").repartition(5)
    rel = [("intrusion-set", f"g{rnd.randrange(6)}", "tool", f"s{rnd.randrange(20)}") for _ in range(60)]
    rel += [("tool", f"s{rnd.randrange(20)}", "attack-pattern", f"t{rnd.randrange(100)}") for _ in range(200)]
    links = spark.createDataFrame([(a, b, "uses", c, d, i % 17 == 0) for i, (a, b, c, d) in enumerate(rel)],
                                  "source_type string, source_ref string, relationship_type string, target_type string, target_ref string, revoked boolean")
    want = {r.group_ref: r["count"] for r in K.techniques_by_software(objects, links).groupBy("group_ref").count().collect()}
    assert {r.group_ref: r.techniques for r in K.technique_counts_by_software(objects, links).collect()} == want and want


def test_expansion_walks_slices(events, monkeypatch):
    """Slices give the depths of the hops, whatever their size, also where ids repeat; the rounds do not grow with the hops."""
    docs = _random_events(150, 21)
    for i, d in enumerate(docs):
        d["event"]["id"] = f"e{i if i % 10 else i // 30}"
    slim = C.slim(events(*docs))
    depth, seen, frontier, d = {0: 0}, {"e0"}, {0}, 0
    while frontier:
        d += 1
        frontier = {j for i in frontier for j in range(len(docs)) if docs[j]["event"]["id"] not in seen and _brute(docs[i], docs[j], 20)}
        seen |= {docs[j]["event"]["id"] for j in frontier}
        depth.update({j: d for j in frontier})
    assert max(depth.values()) > 2
    for rows in (7, 10_000):
        assert {r.seq: r.depth for r in C.expand(slim.where("seq = 0"), slim, 20, slice_rows=rows).collect()} == depth
    assert {r.seq: r.depth for r in C.expand(slim.where("seq = 0"), slim, 20, 2, 7).collect()} == {k: v for k, v in depth.items() if v <= 2}
    chain = [{"@timestamp": at(20 * i), "event": {"id": f"c{i}", "category": "process"}, "host": {"name": "h"},
              "process": {"pid": 100 + i, "parent": {"pid": 99 + i}}} for i in range(60)]
    kept, one = [], C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: kept.append(1) or one(df))
    slim = C.slim(events(*chain))
    assert C.expand(slim.where("seq = 0"), slim, 30).count() == 60 and len(kept) < 20


def test_technique_sets_move_as_arrays(spark):
    """No bitmap of thousands of bytes for a handful of techniques."""
    from emberwatch.operators import knowledge as K

    objects = spark.createDataFrame([(f"t{i}", "attack-pattern", f"T{i}") for i in range(9)], "id string, type string, attack_id string")
    links = spark.createDataFrame([("intrusion-set", "g", "uses", "tool", "s", False)] + [("tool", "s", "uses", "attack-pattern", f"t{i % 9}", False) for i in range(20)],
                                  "source_type string, source_ref string, relationship_type string, target_type string, target_ref string, revoked boolean")
    out = K.technique_counts_by_software(objects, links)
    assert [tuple(r) for r in out.collect()] == [("g", 9)]
    assert "bitmap" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_tables_are_spread_by_rows(spark):
    from emberwatch.sources.tables import use_all_cores

    assert use_all_cores(spark.range(1000).coalesce(1), rows=10).rdd.getNumPartitions() == 100
    assert use_all_cores(spark.range(1000).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_queries_run_in_small_tasks(spark):
    from emberwatch.plans import registry
    from emberwatch.session import QUERY_CONF

    was = {k: spark.conf.get(k, None) for k in QUERY_CONF}
    registry.query("of the test")(lambda spark, folder: None)
    try:
        registry.QUERIES.pop("of the test")(spark, "")
        assert {k: spark.conf.get(k) for k in QUERY_CONF} == QUERY_CONF
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
