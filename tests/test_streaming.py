"""Streams drained once must equal their batch twins."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import behavior as B
from emberwatch.operators.detect import Rule
from emberwatch.sources import audit, honeypot, store, zeek
from emberwatch.streaming import sources as R
from emberwatch.streaming import state as Q

BASE = datetime(2026, 1, 1)


def drain(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def parquet_stream(spark, rows, ddl, path):
    # time-ordered files, so no row is late
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[1]), ddl)
    half = sorted(r[1] for r in rows)[len(rows) // 2]
    df.where(F.col("ts") < half).coalesce(1).write.parquet(f"{path}/a")
    df.where(F.col("ts") >= half).coalesce(1).write.parquet(f"{path}/b")
    return df, spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def test_scan_triggers(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, BASE + timedelta(milliseconds=rnd.randrange(0, 200_000)), "h", rnd.randrange(3), rnd.choice(["ptrace", "write", "read", "execve", "memfd_create", "mprotect"]))
            for i in range(150)]
    df, stream = parquet_stream(spark, rows, "seq long, ts timestamp, host string, pid long, syscall string", str(tmp_path / "in"))
    got = {(r.seq, r.reason) for r in drain(Q.scan_trigger_stream(stream), "triggers").collect()}
    assert got == {(r.seq, r.reason) for r in B.scan_triggers(df).collect()} and got


def test_alerts(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, BASE + timedelta(seconds=rnd.randrange(0, 3000)), "h", rnd.randrange(2), rnd.choice("xy")) for i in range(120)]
    df, stream = parquet_stream(spark, rows, "seq long, ts timestamp, host string, pid long, signature string", str(tmp_path / "in"))
    got = {r.seq for r in drain(Q.alert_stream(stream), "alerts").collect()}
    assert got == {r.seq for r in B.distinct_alerts(df, ["host", "pid"]).collect()} and got


def test_session_addresses(spark, tmp_path):
    rows = [(i, BASE + timedelta(seconds=i), "h", f"s{i % 2}", f"10.0.0.{i}" if i in (2, 5, 9) else None) for i in range(14)]
    _, stream = parquet_stream(spark, rows, "seq long, ts timestamp, host string, session string, address string", str(tmp_path / "in"))
    got = {r.seq: r.source_ip for r in drain(Q.session_address_stream(stream), "sessions").collect()}
    known, want = {}, {}
    for i, _, _, s, a in rows:
        known[s] = a or known.get(s)
        want[i] = known[s]
    assert got == want


def test_sensor_logs_to_scored_table(spark, tmp_path):
    logs = tmp_path / "zeek"
    logs.mkdir()
    recs = [{"ts": 10.0 + i, "id.orig_h": "1.1.1.1", "query": "a" * (60 + i * 10)} for i in range(3)]
    (logs / "dns.log").write_text("#fields\n" + "\n".join(json.dumps(r) for r in recs) + "\n")
    rule = Rule("long", "Long name", "low", "zeek", None, "dns", {"s": {"query|re": "^a{75,}"}, "condition": "s"}, ["discovery"], ["T1"])
    ev = R.detect_and_score(R.zeek_stream(spark, str(logs), "sensor"), [rule])
    q = R.start_table(ev, str(tmp_path / "out"), str(tmp_path / "ckpt"), interval=None)
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    rows = {len(r.dns.question.name): (r.score, [h.rule_id for h in r.hits], r.dt) for r in out.collect()}
    assert rows == {60: (30, [], "1970.01.01"), 70: (30, [], "1970.01.01"), 80: (80, ["long"], "1970.01.01")}
    # a second run finds nothing new
    R.start_table(ev, str(tmp_path / "out"), str(tmp_path / "ckpt"), interval=None).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_honeypot_and_raw_streams(spark, tmp_path):
    logs = tmp_path / "pot"
    logs.mkdir()
    (logs / "cowrie.json").write_text(json.dumps({"eventid": "cowrie.login.failed", "timestamp": "2026-01-01T00:00:00Z", "src_ip": "9.9.9.9"}) + "\nplain text\n")
    row = drain(R.honeypot_stream(spark, str(logs), "pot"), "pot").collect()
    assert [(r.event.outcome, r.source.ip) for r in row] == [("failure", "9.9.9.9")]
    assert "plain text" in {r.message for r in drain(R.raw_log_stream(spark, str(logs)), "rawlog").collect()}


def test_audit_groups_arrive_complete(spark, tmp_path):
    logs = tmp_path / "audit"
    logs.mkdir()
    line = lambda t, s, i: f"type={t} msg=audit({1600000000 + s}.000:{i}): pid=1 comm=x"
    (logs / "a.log").write_text("\n".join([line("SYSCALL", 0, 1), line("EXECVE", 0, 1), line("SYSCALL", 1, 2), line("SYSCALL", 500, 3)]) + "\n")
    q = R.audit_groups_stream(spark, str(logs)).writeStream.format("memory").queryName("groups").trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    q.stop()
    out = spark.table("groups").collect()
    got = {r.audit_id: sorted(m["type"] for m in r.records) for r in out}
    assert {k: got[k] for k in ("1", "2")} == {"1": ["EXECVE", "SYSCALL"], "2": ["SYSCALL"]}


def late_stream(spark, path, batches, ddl):
    """Files of one batch each, read in the order they are given."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{path}/in{i}")
    return spark.readStream.schema(ddl).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


def test_every_late_row_is_kept_apart(spark, tmp_path):
    at = lambda s: BASE + timedelta(seconds=s)
    ddl = "seq long, ts timestamp, host string, pid long, syscall string"
    batches = [[(1, at(0), "h", 1, "ptrace"), (2, at(1000), "h", 1, "write")], [(3, at(5), "h", 1, "ptrace"), (4, at(6), "h", 2, "memfd_create"), (5, at(1001), "h", 1, "ptrace")],
               [(6, at(1003), "h", 1, "write"), (7, at(7), "h", 1, "write")]]
    stream = Q.scan_trigger_stream(late_stream(spark, str(tmp_path / "in"), batches, ddl))
    for _ in range(2):  # the second run finds nothing new
        R.start_split(stream, str(tmp_path / "hits"), str(tmp_path / "late"), str(tmp_path / "ckpt"), interval=None).awaitTermination(120)
    late = spark.read.parquet(str(tmp_path / "late"))
    assert sorted((r.seq, r.syscall, r.reason) for r in late.collect()) == [(3, "ptrace", None), (4, "memfd_create", None), (7, "write", None)]
    hits = spark.read.parquet(str(tmp_path / "hits"))
    assert sorted((r.seq, r.reason) for r in hits.collect()) == [(1, "Suspicious Ptrace"), (5, "Suspicious Ptrace")]


def test_late_alerts_and_sessions(spark, tmp_path):
    at = lambda s: BASE + timedelta(seconds=s)
    alerts = [[(1, at(1000), "h", 1, "x")], [(2, at(3), "h", 1, "x"), (3, at(1001), "h", 1, "x"), (4, at(1002), "h", 1, "y")], [(5, at(1303), "h", 1, "y")]]
    stream = late_stream(spark, str(tmp_path / "a"), alerts, "seq long, ts timestamp, host string, pid long, signature string")
    assert {(r.seq, r.late) for r in drain(Q.alert_stream(stream), "late_alerts").collect()} == {(1, False), (2, True), (4, False), (5, False)}
    events = [[(1, at(1000), "h", "s", "9.9.9.9")], [(2, at(1), "h", "s", None), (3, at(1001), "h", "s", None)]]
    stream = late_stream(spark, str(tmp_path / "s"), events, "seq long, ts timestamp, host string, session string, address string")
    assert {(r.seq, r.source_ip, r.late) for r in drain(Q.session_address_stream(stream), "late_sessions").collect()} == {
        (1, "9.9.9.9", False), (2, None, True), (3, "9.9.9.9", False)}


def test_calls_of_a_busy_process(spark, tmp_path):
    """100,000 calls of one process in one batch: the automaton takes seconds and equals the batch operator."""
    rnd = random.Random(3)
    names = ["ptrace", "write", "read", "execve", "memfd_create", "mprotect"]
    rows = [(i, BASE + timedelta(milliseconds=10 * i), "h", 1, rnd.choice(names)) for i in range(100_000)]
    automaton, started = Q.Calls(10, 5), time.monotonic()
    hits = [seq for seq, ts, *_, call in rows if call != "read" and automaton.step((ts - BASE) // timedelta(microseconds=1), call)]
    assert time.monotonic() - started < 5 and sum(map(len, automaton.state()[:2])) <= 6
    df = spark.createDataFrame(rows, "seq long, ts timestamp, host string, pid long, syscall string")
    assert hits == sorted(r.seq for r in B.scan_triggers(df).collect())


def test_automaton_equals_the_batch_operator_on_sparse_calls(spark):
    rnd = random.Random(8)
    rows, t = [], 0
    for i in range(400):
        t += rnd.choice([0, 1, 100, 2_000, 4_999, 5_000, 9_999, 10_000, 30_000])
        rows.append((i, BASE + timedelta(milliseconds=t), "h", 1, rnd.choice(["ptrace", "write", "execve", "memfd_create", "mprotect"])))
    automaton, got = Q.Calls(10, 5), {}
    for seq, ts, *_, call in rows:
        automaton = Q.Calls(10, 5, automaton.state())  # as it comes out of the state store
        why = automaton.step((ts - BASE) // timedelta(microseconds=1), call)
        if why:
            got[seq] = why
    df = spark.createDataFrame(rows, "seq long, ts timestamp, host string, pid long, syscall string")
    want = {r.seq: r.reason for r in B.scan_triggers(df).collect()}
    assert sorted(got.items()) == sorted(want.items())


def test_family_sink_commits_every_batch_once(spark, tmp_path):
    root, logs = str(tmp_path / "store"), tmp_path / "pot"
    logs.mkdir()
    line = json.dumps({"eventid": "cowrie.login.failed", "timestamp": "2026-01-01T00:00:00Z", "src_ip": "9.9.9.9"})
    (logs / "cowrie.json").write_text(f"{line}\n{line}\n")

    def run():
        q = R.start_family(R.honeypot_stream(spark, str(logs), "pot"), root, str(tmp_path / "ckpt"), "pot", "honeypot-logs", interval=None)
        q.awaitTermination(120)
        assert q.exception() is None
        return store.read_family(spark, root, ["honeypot-logs"]).collect()

    rows = run()
    assert len(rows) == 2 and len({r.event.id for r in rows}) == 2  # equal lines are two events
    assert all(len(r.event.id) == 36 and r.event.category == "authentication" and r.dt == "2026.01.01" for r in rows)
    with open(logs / "cowrie.json", "a") as f:
        f.write(line + "\n")
    assert len(run()) == 3 and len(run()) == 3
    assert store.committed(spark, root, "honeypot-logs", "pot") == 1


def test_repeated_and_broken_batches(spark, tmp_path, events):
    root = str(tmp_path)
    doc = {"@timestamp": "2026-01-15T00:00:00Z", "event": {"action": "login"}}
    df = events(doc, doc, {**doc, "event": {"id": "own", "category": "file"}}).drop("seq", "case_id")
    assert store.write_batch(df, 0, root, "f", "s") == {"success": 3, "failed": 0}
    assert store.write_batch(df, 0, root, "f", "s") is None
    # an attempt that failed left rows of batch 1 behind, in two days, and no commit
    store._write(store.prepare(df), root, "f", "s@1", 0)
    store._write(store.prepare(df), root, "f", "s@1", 24)
    back = lambda: store.read_family(spark, root, ["f"])
    assert back().count() == 3 and "batch" not in back().columns
    store.write_batch(df.limit(1), 1, root, "f", "s")
    assert back().count() == 4
    store.write_events(df, root, "f")
    store.write_batch(df, 0, root, "f", "other")
    assert back().count() == 10
    ids = [r[0] for r in back().select("event.id").collect()]
    assert ids.count("own") == 3 and len(set(ids)) == 3
    for bad in ("a@b", "a/b", ""):
        with pytest.raises(ValueError):
            store.write_batch(df, 0, root, "f", bad)


def test_equal_rows_get_ids_of_their_own(spark, events):
    doc = {"@timestamp": "2026-01-15T00:00:00Z", "event": {"action": "x"}}
    rows = events(*[doc] * 40, {**doc, "event": {"id": "own"}}).drop("seq", "case_id")
    ids = lambda n: sorted(r[0] for r in store.with_ids(rows.repartition(n)).select("event.id").collect())
    assert len(set(ids(7))) == 41 and ids(7) == ids(1)
    assert store.with_ids(rows.limit(0)).count() == 0


def test_parsers_do_not_need_streams(spark):
    df = spark.createDataFrame([("dns", "{}")], "log string, value string")
    assert zeek.parse_lines(df).count() == 1
    assert honeypot.parse_lines(df).count() == 0
    assert audit.is_audit_line(F.lit("type=x")) is not None
