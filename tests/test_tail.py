"""Growing, rotated and truncated log files: every line once, also after a restart."""

import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from emberwatch.streaming import sources as R
from emberwatch.streaming import tail


class Tail:
    """A stream into a Parquet table, drained step by step; every step is a restart from the checkpoint."""

    def __init__(self, spark, root, **options):
        self.spark, self.root, self.logs = spark, root, root / "logs"
        self.logs.mkdir()
        self.options = options

    def write(self, name, text, mode="a"):
        with open(self.logs / name, mode, newline="") as f:
            f.write(text)

    def drain(self):
        lines = tail.follow(self.spark, str(self.logs), **self.options)
        q = lines.writeStream.format("parquet").option("path", str(self.root / "out")).option("checkpointLocation", str(self.root / "ckpt")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r.value for r in self.rows())

    def rows(self):
        return self.spark.read.parquet(str(self.root / "out")).collect()


def test_appended_lines_once(spark, tmp_path):
    t = Tail(spark, tmp_path)
    t.write("a.log", "one\ntwo\nhal")
    assert t.drain() == ["one", "two"]
    assert t.drain() == ["one", "two"]
    t.write("a.log", "f\nthree\n")
    t.write("b.log", "four\r\n\n")
    assert t.drain() == ["", "four", "half", "one", "three", "two"]
    assert len({r.line_id for r in t.rows()}) == 6


def test_rotation_keeps_the_rest_of_the_old_file(spark, tmp_path):
    t = Tail(spark, tmp_path, pattern="audit.log*")
    t.write("audit.log", "1\n2\n")
    t.write("other", "no\n")
    assert t.drain() == ["1", "2"]
    t.write("audit.log", "3\n")
    os.rename(t.logs / "audit.log", t.logs / "audit.log.1")
    t.write("audit.log", "4\n")
    assert t.drain() == ["1", "2", "3", "4"]
    os.rename(t.logs / "audit.log.1", t.logs / "audit.log.2")
    os.rename(t.logs / "audit.log", t.logs / "audit.log.1")
    t.write("audit.log", "5\n")
    assert t.drain() == ["1", "2", "3", "4", "5"]


@pytest.mark.parametrize("after", ["x\n", "a much longer line than before\nand one more\n", ""])
def test_truncation_starts_anew(spark, tmp_path, after):
    t = Tail(spark, tmp_path)
    t.write("a.log", "old 1\nold 2\n")
    t.drain()
    t.write("a.log", after, mode="w")
    assert t.drain() == sorted(["old 1", "old 2", *after.splitlines()])
    t.write("a.log", "last\n")
    assert t.drain() == sorted(["old 1", "old 2", *after.splitlines(), "last"])


def test_the_last_line_of_a_file_nobody_writes(spark, tmp_path):
    t = Tail(spark, tmp_path, settle_seconds=1)
    t.write("a.log", "one\nno end")
    os.utime(t.logs / "a.log", (1, 1))
    assert t.drain() == ["no end", "one"]


def test_large_growth_is_read_by_many_tasks(spark, tmp_path):
    t = Tail(spark, tmp_path, split_bytes=1000)
    rnd = random.Random(1)
    lines = [f"{i} " + "x" * rnd.choice([0, 3, 990, 2500]) for i in range(300)]
    t.write("a.log", "\n".join(lines) + "\n")
    assert t.drain() == sorted(lines)
    reader = tail.TailReader(str(t.logs), "*", 1000, None)
    spans = reader.partitions({}, reader.latestOffset())
    assert len(spans) > 100 and [x[0] for s in spans for x in reader.read(s)] == lines


def test_a_batch_run_again_reads_the_same_bytes(tmp_path):
    (tmp_path / "a.log").write_text("1\n2\n")
    reader = tail.TailReader(str(tmp_path), "*", 1 << 20, None)
    first = reader.latestOffset()
    (tmp_path / "a.log").write_text("1\n2\n3\n")
    second = reader.latestOffset()
    with open(tmp_path / "a.log", "a") as f:
        f.write("4\n")
    os.rename(tmp_path / "a.log", tmp_path / "b.log")
    again = tail.TailReader(str(tmp_path), "*", 1 << 20, None)
    assert [x[0] for s in again.partitions(first, second) for x in again.read(s)] == ["3"]
    assert list(tail.offsets(__import__("json").dumps(second)).values()) == [6]


def test_files_that_vanish(tmp_path):
    (tmp_path / "a.log").write_text("1\n")
    reader = tail.TailReader(str(tmp_path), "*", 1 << 20, None)
    end = reader.latestOffset()
    spans = reader.partitions({}, end)
    os.rename(tmp_path / "a.log", tmp_path / "moved.log")
    assert [x[0] for s in spans for x in reader.read(s)] == ["1"]
    assert [x[1] for s in spans for x in reader.read(s)] == ["a.log"]
    (tmp_path / "moved.log").unlink()
    assert [x for s in spans for x in reader.read(s)] == [] and reader.partitions({}, end) == []


def test_a_running_stream_follows_a_writer(spark, tmp_path):
    """Lines written, rotated and copied-and-truncated while the stream runs arrive once."""
    logs = tmp_path / "logs"
    logs.mkdir()
    want = []

    def write():
        for step in range(4):
            with open(logs / "a.log", "a") as f:
                for k in range(50):
                    want.append(f"{step}-{k}")
                    f.write(f"{step}-{k}\n")
                    f.flush()
            time.sleep(0.3)
            if step == 1:
                os.rename(logs / "a.log", logs / "a.log.1")

    q = (tail.follow(spark, str(logs), pattern="a.log*").writeStream.format("memory").queryName("followed")
         .trigger(processingTime="200 milliseconds").start())
    writer = threading.Thread(target=write)
    writer.start()
    writer.join()
    deadline = time.time() + 60
    while time.time() < deadline and spark.table("followed").count() < len(want):
        time.sleep(0.5)
    q.stop()
    assert sorted(r.value for r in spark.table("followed").collect()) == sorted(want)


def test_sensor_and_audit_streams_follow_files(spark, tmp_path):
    logs = tmp_path / "zeek"
    logs.mkdir()
    out = lambda: spark.read.parquet(str(tmp_path / "out")) if (tmp_path / "out").exists() else None

    def drain():
        ev = R.zeek_stream(spark, str(logs), "sensor")
        R.start_table(ev, str(tmp_path / "out"), str(tmp_path / "ckpt"), interval=None).awaitTermination(120)
        return out().count()

    (logs / "dns.log").write_text('{"ts": 1.0, "id.orig_h": "1.1.1.1", "query": "a"}\n')
    assert drain() == 1
    with open(logs / "dns.log", "a") as f:
        f.write('{"ts": 2.0, "id.orig_h": "1.1.1.1", "query": "b"}\n')
    assert drain() == 2
    os.rename(logs / "dns.log", logs / "dns.2026-01-01.log")
    (logs / "conn.log").write_text('{"ts": 3.0, "id.orig_h": "2.2.2.2", "proto": "icmp"}\n')
    assert drain() == 3
    assert {r[0] for r in out().select(F.col("source.ip")).collect()} == {"1.1.1.1", "2.2.2.2"}
