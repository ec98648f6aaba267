"""Parsers, storage and ordered helpers."""

import json
import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from emberwatch.functions.columns import decode_hex, entropy, parse_iso, rejected
from emberwatch.functions.ordered import line_chunk, with_last_known, with_previous, with_running_sum
from emberwatch.operators import behavior as B
from emberwatch.operators import intel as I
from emberwatch.operators import knowledge as K
from emberwatch.schema import conform, to_documents
from emberwatch.sources import audit, honeypot, memory, stix, store, windows, zeek


def lines(spark, *texts, file="f"):
    return spark.createDataFrame([(file, i, t) for i, t in enumerate(texts)], "file string, line_no long, value string")


H = "msg=audit(1600000000.333:{}): "


def groups(spark, mode, *texts):
    g = audit.group_records(audit.parse_lines(lines(spark, *texts)), mode, block=2)
    return sorted((r.audit_id, [m.get("type") for m in r.records]) for r in g.collect())


def rec(t, i, rest=""):
    return f"type={t} {H.format(i)}{rest}"


def test_audit_groups(spark):
    texts = [rec("SYSCALL", 1), rec("CWD", 1), rec("EOE", 1), rec("SYSCALL", 2), rec("SYSCALL", 3), rec("PATH", 3)]
    assert groups(spark, "contiguous", *texts) == [("1", ["SYSCALL", "CWD", "EOE"]), ("2", ["SYSCALL"])]
    assert groups(spark, "by_id", *texts) == [("1", ["SYSCALL", "CWD", "EOE"]), ("2", ["SYSCALL"]), ("3", ["SYSCALL", "PATH"])]
    mixed = [rec("SYSCALL", 1), rec("SYSCALL", 2), rec("CWD", 1), rec("EOE", 2)]
    # interleaved ids fall apart, and a run right before an EOE line of another id is lost
    assert groups(spark, "contiguous", *mixed) == [("1", ["SYSCALL"]), ("2", ["EOE"]), ("2", ["SYSCALL"])]


def test_audit_event(spark):
    texts = [
        rec("USER_LOGIN", 1, "pid=1 ses=5 addr=10.9.9.9 res=success"),
        rec("SYSCALL", 2, 'ppid=7 pid=3000 auid=u uid=0 ses=5 comm="cat" exe="/bin/cat" res=failed'), rec("EXECVE", 2, 'argc=3 a0="cat" a1="/tmp/x" a3="lost"'),
        rec("CWD", 2, 'cwd="/home/user"'), rec("PATH", 2, 'name="/bin" nametype=PARENT'), rec("PATH", 2, 'name="/etc/shadow" nametype=NORMAL'),
        rec("SYSCALL", 3, 'pid=1 ses=4294967295 uid=5 comm="ls" exe="/bin/ls" proctitle="ls /tmp"'),
    ]
    ev = {r.audit_id: r for r in audit.group_events(audit.group_records(audit.parse_lines(lines(spark, *texts))), "h", block=2).collect()}
    a = ev["2"]
    assert (a.event.severity, a.event.outcome, a.detection.severity) == (10, "failure", "critical")
    assert (a.process.pid, a.process.parent.pid, a.process.command_line, a.process.cwd) == (3000, 7, "cat /tmp/x", "/home/user")
    assert a.file.path == "/etc/shadow" and a.source.ip == "10.9.9.9" and a["@timestamp"] == "2020-09-13T12:26:40.333000Z"
    assert ev["1"].event.category == "authentication" and ev["1"].source.ip == "10.9.9.9"
    # quoted values end at the first blank
    assert ev["3"].source.ip is None and ev["3"].process.command_line == "ls" and ev["3"].event.severity == 1


def test_ingest_filter(events):
    doc = lambda name, cmd, user=None: {"event": {"category": "process", "action": "process_started"}, "process": {"name": name, "command_line": cmd}, "user": {"name": user}}
    df = events(doc("bash", ""), doc("sleep", "sleep 5"), doc("sleep", "sleep 99"), doc("date", "date", "www-data"), doc("bash", "bash x"))
    assert sorted(r.seq for r in audit.ingest_filter(df).collect()) == [2, 3, 4]
    assert audit.ingest_filter(df, filtered=False).count() == 5


def test_raw_lines(spark):
    out = audit.raw_events(lines(spark, "kernel: hello", rec("SYSCALL", 1), " "))
    assert [r.message for r in out.collect()] == ["kernel: hello"]


def test_windows_process(spark):
    rows = [(4688, "2023-10-27T10:05:00.000000Z", {"NewProcessName": "C:\\Windows\\cmd.exe", "CommandLine": "cmd /c", "ProcessId": "0x1234", "ParentProcessId": "0x456"}, "m", (None,)),
            (None, "t", {"TargetUserName": "u", "IpAddress": "10.1.1.1"}, "m", (4624,)), (4625, "t", {}, "m", (None,))]
    df = windows.normalise_records(spark.createDataFrame(rows, windows.RECORD_DDL))
    p, logon, other = df.collect()
    assert (p.process.pid, p.process.parent.pid, p.process.name) == (4660, 1110, "cmd.exe")
    assert (logon.event.category, logon.source.ip, logon.event.severity) == ("iam", "10.1.1.1", 1)
    assert other.event.category is None and other.event.dataset == "windows"
    hosts = [r.host.name for r in windows.attribute_remote(df, "dc").collect()]
    assert hosts == ["dc", "Remote-Host-10.1.1.1", "dc"]


def test_zeek_detectors(spark):
    rec_ = lambda **k: json.dumps({"ts": 1.5, "id.orig_h": "1.1.1.1", **k})
    rows = [("dns", rec_(query="a" * 71)), ("dns", rec_(query="a.b.c.d.e.f.g.h")), ("dns", rec_(query="ok.example")), ("conn", rec_(proto="icmp", orig_bytes=801)),
            ("conn", rec_(proto="icmp", orig_bytes=800)), ("ssl", rec_(version="TLSv10")), ("files", rec_(md5="x")), ("dns", "#comment"), ("dns", "{bad")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "seq long, log string, value string")
    got = {r.seq: r for r in zeek.zeek_events(zeek.parse_lines(df), "s", {"seq": F.col("seq")}).collect()}
    assert [got[i].event.severity for i in range(7)] == [7, 7, 3, 7, 3, 7, 3]
    assert got[0].detection.rules == ["DNS Anomaly: Length(71)"] and got[1].detection.rules == ["DNS Anomaly: Depth(8)"]
    assert got[0]["@timestamp"] == "1970-01-01T00:00:01.500000Z" and got[6].file.name == "unknown" and 7 not in got


def test_honeypot_audit(spark):
    cmds = ["curl x", "cat /etc/passwd", "rm -f a", "ls", ""]
    rows = [(json.dumps({"eventid": "cowrie.command.input", "timestamp": "2026-01-01T00:00:00Z", "input": c}),) for c in cmds]
    rows.append((json.dumps({"eventid": "cowrie.client.kex"}),))
    out = honeypot.honeypot_events(honeypot.parse_lines(spark.createDataFrame(rows, "value string")), "pot").collect()
    assert [(r.event.severity, r.threat.technique.id) for r in out] == [(8, "T1105"), (7, "T1087"), (6, "T1070"), (5, None), (3, None)]
    assert out[0].process.name == "curl" and out[0].destination.port == 2222 and out[0].user.name == "unknown"


def test_memory_cascade(spark):
    rows = [("00400000-00452000 r-xp 0 08:02 1 /memfd:a", True), ("00400000-00452000 rwxp 0 0 0", False), ("00400000-00452000 rwxp 0 0 0 [stack]", False),
            ("00400000-00452000 rwxp 0 0 0 /usr/lib/x y", False), ("00400000-00452000 r-xp 0 0 0", True), ("00400000-00452000 r-xp 0 0 0 /bin/a", True), ("00400000-00452000 rw-p 0 0 0", True)]
    df = spark.createDataFrame([(i, "c", r, e) for i, (r, e) in enumerate(rows)], "pid int, comm string, maps_line string, is_elf boolean")
    got = {r.pid: (r.type, r.risk_level, r.size) for r in memory.linux_anomalies(df).collect()}
    size = 0x52000
    assert got == {0: ("MEMFD_EXEC", "CRITICAL", size), 1: ("RWX_REGION", "HIGH", size), 2: ("RWX_REGION", "CRITICAL", size),
                   3: ("RWX_REGION", "MEDIUM", size), 4: ("ANON_ELF", "HIGH", size)}


def test_conform_and_documents(spark):
    docs = [{"timestamp": "2026-01-15T11:12:45Z", "event": {"category": "file", "junk": 1}, "source": "broken", "extra": {}, "message": ""}]
    df = conform(spark.createDataFrame([(json.dumps(d),) for d in docs], "value string"))
    r = df.first()
    assert r["@timestamp"] == "2026-01-15T11:12:45Z" and r.event.severity == 5 and r.source.ip is None and r.message is None
    assert json.loads(to_documents(df).first().value) == {"@timestamp": "2026-01-15T11:12:45Z", "event": {"category": "file", "severity": 5}}


def test_store_round_trip(spark, tmp_path, events):
    doc = lambda t, **k: {"@timestamp": t, "event": {"severity": 1}, **k}
    df = events(doc("2026-01-15T23:30:00Z", user={"name": "u"}, event={"outcome": "success"}), doc("2026-01-16T01:00:00Z", network={"protocol": "dns"}), doc("nonsense"))
    root = str(tmp_path)
    assert store.write_events(df, root, "unified-logs", day_shift_hours=8) == {"success": 2, "failed": 1}
    back = store.read_family(spark, root)
    rows = back.where("dt <> 'rejected'").orderBy("ts").collect()
    assert [r.dt for r in rows] == ["2026.01.16", "2026.01.16"] and [r.event.category for r in rows] == ["authentication", "network"]
    assert all(len(r.event.id) == 36 for r in rows)
    hit = store.query_events(back, "2026-01-16", "2026-01-17", {"event.category": "network"})
    assert hit.count() == 1


def test_text_helpers(spark):
    df = spark.createDataFrame([("aabb", "2026-01-15T11:12:45.123456789Z", "6c73202d6c61"), ("", "bad", "abc")], "a string, b string, c string")
    x, y = df.select(entropy(F.col("a")).alias("e"), parse_iso(F.col("b")).alias("t"), decode_hex(F.col("c")).alias("h")).collect()
    assert (x.e, y.e) == (1.0, 0.0) and x.t == datetime(2026, 1, 15, 11, 12, 45, 123456) and y.t is None
    assert (x.h, y.h) == ("ls -la", "abc")


def test_ordered_helpers_equal_plain_windows(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), i, rnd.choice([None, 1, 2, 3]), rnd.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, seq long, v int, n int").withColumn("c", line_chunk(F.col("seq"), 7))
    df = with_previous(df, ["k"], "c", ["seq"], {"prev": F.col("n")})
    df = with_running_sum(df, ["k"], "c", ["seq"], F.col("n"), "total")
    df = with_last_known(df, ["k"], "c", ["seq"], F.col("v"), "known")
    state = {}
    got = {r.seq: r for r in df.collect()}
    for k, i, v, n in rows:
        prev, total, known = state.get(k, (None, 0, None))
        total, known = total + n, v if v is not None else known
        assert (got[i].prev, got[i].total, got[i].known) == (prev, total, known)
        state[k] = (n, total, known)


def _fold(rows, gap):
    last, out = {}, set()
    for host, seq, t in sorted(rows, key=lambda r: (r[2], r[1])):
        if host not in last or t - last[host] >= gap:
            last[host] = t
            out.add(seq)
    return out


def test_debounce_equals_the_fold(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice(["a", "b", "hot", "hot", "hot"]), i, rnd.randrange(0, 400_000_000)) for i in range(1500)]
    base = datetime(2026, 1, 1)
    df = spark.createDataFrame([(h, i, base + timedelta(microseconds=t)) for h, i, t in rows], "host string, seq long, ts timestamp")
    for gap, chunk in ((5, 7), (5, 3600), (30, 30), (1, 2)):
        got = {r.seq for r in B.debounce(df, ["host"], gap, chunk).collect()}
        assert got == _fold(rows, gap * 1_000_000), (gap, chunk)


def test_debounce_of_one_busy_key(spark):
    # a million distinct times inside a few gaps of one key
    df = spark.range(1_000_000).select(F.lit("h").alias("host"), F.col("id").alias("seq"), F.timestamp_micros(F.col("id") * 1000).alias("ts"))
    started = time.monotonic()
    got = sorted(r.seq for r in B.debounce(df, ["host"], 300).collect())
    assert got == [0, 300_000, 600_000, 900_000] and time.monotonic() - started < 60


def test_debounce_of_no_rows_and_no_times(spark):
    df = spark.createDataFrame([("h", 1, None), (None, 2, datetime(2026, 1, 1)), (None, 3, datetime(2026, 1, 1))], "host string, seq long, ts timestamp")
    assert [r.seq for r in B.debounce(df, ["host"], 5).collect()] == [2]
    assert B.debounce(df.limit(0), ["host"], 5).count() == 0


def test_distinct_alerts_equal_the_fold(spark):
    rnd = random.Random(4)
    base = datetime(2026, 1, 1)
    rows = [(i, rnd.randrange(0, 4000), rnd.choice("xy")) for i in range(400)]
    df = spark.createDataFrame([("h", 1, i, base + timedelta(seconds=t), s) for i, t, s in rows], "host string, pid int, seq long, ts timestamp, signature string")
    last, sig, want = None, None, set()
    for i, t, s in sorted(rows, key=lambda r: (r[1], r[0])):
        if last is None or s != sig or t - last >= 300:
            last, sig = t, s
            want.add(i)
    assert {r.seq for r in B.distinct_alerts(df, ["host", "pid"], 300, 300).collect()} == want


def _bundle(tmp_path):
    ref = lambda i: [{"source_name": "mitre-attack", "external_id": i, "url": "u"}]
    objs = [
        {"type": "attack-pattern", "id": "attack-pattern--1", "name": "Alpha", "external_references": ref("T1"), "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "execution"}], "x_mitre_platforms": ["Linux"]},
        {"type": "attack-pattern", "id": "attack-pattern--2", "name": "Beta", "external_references": ref("T1.001"), "x_mitre_is_subtechnique": True, "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "discovery"}]},
        {"type": "attack-pattern", "id": "attack-pattern--3", "name": "Old", "external_references": ref("T3"), "revoked": True},
        {"type": "intrusion-set", "id": "intrusion-set--1", "name": "GroupA", "aliases": ["GroupA", "Bear"], "external_references": ref("G1"), "description": "Some text"},
        {"type": "intrusion-set", "id": "intrusion-set--2", "name": "GroupB", "external_references": ref("G2"), "x_mitre_deprecated": True},
        {"type": "tool", "id": "tool--1", "name": "Tool"}, {"type": "campaign", "id": "campaign--1", "name": "Camp"},
        {"type": "x-mitre-matrix", "id": "m--1", "name": "M", "tactic_refs": ["x-mitre-tactic--2", "x-mitre-tactic--1"]},
        {"type": "x-mitre-tactic", "id": "x-mitre-tactic--1", "name": "One"}, {"type": "x-mitre-tactic", "id": "x-mitre-tactic--2", "name": "Two"},
    ]
    link = lambda s, r, t, **k: {"type": "relationship", "id": f"{s}{r}{t}", "source_ref": s, "relationship_type": r, "target_ref": t, **k}
    objs += [link("intrusion-set--1", "uses", "attack-pattern--1"), link("intrusion-set--1", "uses", "attack-pattern--3"), link("intrusion-set--1", "uses", "attack-pattern--2", revoked=True),
             link("campaign--1", "uses", "tool--1"), link("campaign--1", "attributed-to", "intrusion-set--1"), link("tool--1", "uses", "attack-pattern--2"),
             link("intrusion-set--1", "uses", "tool--1"), link("attack-pattern--3", "revoked-by", "attack-pattern--1"), link("attack-pattern--2", "subtechnique-of", "attack-pattern--1")]
    path = tmp_path / "bundle.json"
    path.write_text(json.dumps({"type": "bundle", "objects": objs}, indent=1))
    return str(path)


def test_knowledge_base(spark, tmp_path):
    b = stix.read_bundle(spark, _bundle(tmp_path))
    kb = stix.objects(b), stix.relationships(b)
    assert [r.technique_id for r in K.techniques_of_group(*kb, "bear").collect()] == ["T1"]
    assert [r.group for r in K.groups_of_technique(*kb, "alpha").collect()] == ["GroupA"]
    assert [r.name for r in K.search_groups(kb[0], "TEXT").collect()] == ["GroupA"]
    s = K.statistics(*kb).first()
    assert (s.total_groups, s.total_techniques, s.total_relationships, s.subtechniques) == (1, 2, 1, 1)
    assert [r.software for r in K.software_of_groups(*kb).collect()] == ["tool--1"]
    assert [r.attack_id for r in K.techniques_by_software(*kb).collect()] == ["T1.001"]
    assert [(r.old_id, r.new_name) for r in K.replaced_by(*kb).collect()] == [("attack-pattern--3", "Alpha")]
    assert [r.object_id for r in K.mapping(*kb, "subtechnique_of_technique", reverse=True).collect()] == ["attack-pattern--1"]
    assert [r.tactic for r in K.matrix_tactics(kb[0]).orderBy("position").collect()] == ["Two", "One"]
    assert [r.attack_sequence for r in I.playbooks(K.uses_edges(*kb)).collect()] == [["SHELL_EXECUTION"]]


def test_overlap_attribution(spark):
    cases = spark.createDataFrame([("c", t) for t in ("T1", "T2", "T1071")] + [("d", "T9")], "case string, technique_id string")
    groups = spark.createDataFrame([("A", "T1"), ("A", "T2"), ("A", "T5"), ("B", "T1071"), ("C", "T7")], "group string, technique_id string")
    got = {r.group: (r.score, r.jaccard, r.recall) for r in I.overlap_scores(cases, groups, ["case"]).collect()}
    assert got == {"A": (round(0.3 * 2 / 4 + 0.7 * 2 / 3, 3), 0.5, 0.667), "B": (round((0.3 / 3 + 0.7 / 3) * 1.1, 3), 0.333, 0.333)}
    verdict = {r.case: (r.suspected_group, r.score) for r in I.attribute(I.overlap_scores(cases, groups, ["case"]), cases, ["case"]).collect()}
    assert verdict == {"c": ("A", 0.617), "d": ("Unclassified", 0.0)}


def test_scores_of_equal_technique_sets(spark):
    """Cases with the same techniques are scored once, and the best groups are picked before the cases are joined."""
    cases = spark.createDataFrame([(c, t) for c in range(40) for t in ("T1", "T2", "T3")[:1 + c % 3]] + [(None, "T1")], "case int, technique_id string")
    groups = spark.createDataFrame([(g, t) for g, ts in {"A": "12", "B": "123", "C": "1", "D": "3"}.items() for t in (f"T{x}" for x in ts)], "group string, technique_id string")
    full = I.overlap_scores(cases, groups, ["case"])
    want = {}
    for r in full.collect():
        want.setdefault(r.case, []).append((-r.score, r.group, tuple(r.matched_ttps)))
    assert set(want) == set(range(40)) and (("T1", "T2") in {m for _, _, m in want[2]})
    for n in (1, 2):
        got = {}
        for r in I.overlap_scores(cases, groups, ["case"], best=n).collect():
            got.setdefault(r.case, []).append((-r.score, r.group, tuple(r.matched_ttps)))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:n] for k, v in want.items()}


def test_audit_steps_are_not_repeated(spark):
    """Runs of records take one join of summaries; filters behind the events read texts, not the records."""
    lines = spark.createDataFrame([("f", i, f"type={t} msg=audit(1.5:{n}): ses=1 comm=\"ls\" a0=\"ls\"") for i, (t, n) in enumerate(
        [("SYSCALL", 1), ("EXECVE", 1), ("EOE", 1), ("SYSCALL", 2), ("CWD", 2), ("SYSCALL", 3), ("EOE", 9), ("EOE", 9), ("SYSCALL", 4)])], "file string, line_no long, value string")
    parsed = audit.parse_lines(lines)
    for block in (1, 2, 4, 100):
        runs = audit.group_records(parsed, "contiguous", block)
        assert sorted((r.audit_id, r.first_line, len(r.records)) for r in runs.collect()) == [("1", 0, 3), ("2", 3, 2), ("9", 6, 1), ("9", 7, 1)]
    nameless = audit.group_records(parsed.withColumn("file", F.lit(None).cast("string")), "contiguous")
    assert sorted(r.audit_id for r in nameless.collect()) == ["1", "9", "9"]  # only what an EOE closes
    assert runs._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    plan = audit.ingest_filter(audit.group_events(audit.group_records(parsed), "h"))._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "records" in x]


def test_sequence_similarity_equals_difflib(spark):
    import difflib
    rnd = random.Random(2)
    seq = lambda: [rnd.choice("ABCDEF") for _ in range(rnd.randrange(1, 7))]
    s = [(f"c{i}", seq()) for i in range(12)]
    p = [(f"g{i}", seq()) for i in range(8)]
    got = {(r.case, r.group): r.score for r in I.sequence_similarity(
        spark.createDataFrame(s, "case string, sequence array<string>"), spark.createDataFrame(p, "group string, attack_sequence array<string>"), ["case"]).collect()}
    want = {(a, b): round(difflib.SequenceMatcher(None, x, y).ratio(), 3) for a, x in s for b, y in p}
    assert got == {k: v for k, v in want.items() if v > 0}


def test_sequence_similarity_of_shapes(spark, monkeypatch):
    """Labels of one side only are gaps; repeats and long sequences count as difflib counts them, and each shape is compared once."""
    import difflib
    rnd = random.Random(5)
    some = lambda letters: rnd.sample(letters, rnd.randrange(1, len(letters)))
    s = [(f"c{i}", some("ABCDEFuvwxyz")) for i in range(60)] + [(None, ["A", None, "B"]), ("r", list("ABABuA")), ("long", list("ABCu" * 60)), ("none", ["u"])]
    p = [(f"g{i:02}", some("ABCDEF123456")) for i in range(40)] + [("n", ["A", None, "B"]), ("r", list("BAB1BA")), ("long", list("AB12" * 55) + ["C"])]
    want = {(a, b): round(difflib.SequenceMatcher(None, x, y).ratio(), 3) for a, x in s for b, y in p if set(x) & set(y) - {None}}
    cases = spark.createDataFrame(s, "case string, sequence array<string>")
    books = spark.createDataFrame(p, "group string, attack_sequence array<string>")
    got = {(r.case, r.group): r.score for r in I.sequence_similarity(cases, books, ["case"]).collect()}
    assert got == want
    best = {r.case: (r.group, r.score) for r in I.sequence_similarity(cases, books, ["case"], best=True).collect()}
    assert best == {c: min(((g, v) for (k, g), v in want.items() if k == c), key=lambda x: (-x[1], x[0])) for c in {c for c, _ in want}}
    # cases that differ in labels no playbook has are one comparison
    many = spark.createDataFrame([(i, [f"u{i}", "A", f"v{i}", "B"]) for i in range(200)], "case int, sequence array<string>")
    compared, one = [], I._shape_matches
    monkeypatch.setattr(I, "_shape_matches", lambda a, b: compared.append(one(a, b).count()) or one(a, b))
    assert I.sequence_similarity(many, books.where("group <> 'long'"), ["case"]).select("case").distinct().count() == 200
    assert 0 < compared[0] <= len(p)


def test_indicator_priority(spark):
    ddl = "ioc string, risk_score int, source string"
    local, feed = spark.createDataFrame([("1.1.1.1", 10, "local")], ddl), spark.createDataFrame([("1.1.1.1", 90, "feed"), ("2.2.2.2", 70, "feed")], ddl)
    seen = spark.createDataFrame([("1.1.1.1",), ("2.2.2.2",), ("3.3.3.3",)], "ioc string")
    got = {r.ioc: (r.source, r.is_malicious) for r in I.enrich(seen, local, feed).collect()}
    assert got == {"1.1.1.1": ("local", False), "2.2.2.2": ("feed", True)}


def test_call_patterns(spark):
    base = datetime(2026, 1, 1, 0, 59, 55)
    calls = [(0, 0, "ptrace"), (1, 3, "read"), (2, 6, "write"), (3, 9, "write"), (4, 10, "read"), (5, 40, "memfd_create"), (6, 60, "mprotect")]
    df = spark.createDataFrame([(i, base + timedelta(seconds=s), "h", 1, c) for i, s, c in calls], "seq long, ts timestamp, host string, pid long, syscall string")
    got = {r.seq: r.reason for r in B.call_patterns(df).collect()}
    assert got == {0: "Suspicious Ptrace", 1: "Suspicious Ptrace", 2: "Ptrace Injection", 3: "Ptrace Injection", 4: None, 5: "Memfd Creation", 6: None}


def test_broken_lines_are_refused(spark):
    good = '{"@timestamp": "2026-01-01T00:00:00Z", "event": {"id": "a", "severity": 2}}'
    df = spark.createDataFrame([(good,), (good[:-1],), ("",), ("# note",), (None,), ("[1]",), ("{}",)], "value string")
    assert sorted(r.s for r in conform(df).select(F.col("event.severity").alias("s")).collect()) == [2, 5]
    assert sorted(r.value for r in rejected(df).collect()) == sorted([good[:-1], "[1]"])
    flows = df.withColumn("log", F.lit("conn"))
    assert zeek.parse_lines(flows).count() == 2 and honeypot.parse_lines(df, all_events=True).count() == 0


def test_audit_ids_of_two_boots_stay_apart(spark):
    a = 'type=SYSCALL msg=audit(1700000000.000:7): syscall=59 pid=1'
    b = 'type=SYSCALL msg=audit(1790000000.000:7): syscall=59 pid=2'
    assert audit.group_records(audit.parse_lines(lines(spark, a, b))).count() == 2


def test_missing_ids_are_the_same_on_every_run(spark):
    df = conform(spark.createDataFrame([('{"@timestamp": "2026-01-01T00:00:00Z", "message": "m"}',)], "value string"))
    assert store.prepare(df).first()["event"]["id"] == store.prepare(df).first()["event"]["id"]
