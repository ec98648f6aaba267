"""Log search in raw records and counts in one pass."""

import json

from pyspark.sql import functions as F

from emberwatch.operators import dashboard as D


def test_search_reads_values_of_raw_records(spark):
    records = [{"TargetObject": "C:\\Windows\\System32", "n": 17, "list": ["a\"b", {"Deep": "x: y"}]}, {"other": "targetobject: yes"}, {}]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(3, 'plain "TargetObject": text'), (4, None), (5, '{"broken": "TargetObject')]
    df = spark.createDataFrame(rows, "seq long, raw string")
    found = lambda q: sorted(r.seq for r in D.search(df, q, ["raw"]).collect())
    assert found("c:\\windows\\system32") == [0]
    assert found("targetobject") == [1, 3, 5]  # as a value, in plain text and in a broken record, not as a key
    assert found("17") == [0] and found('a"b') == [0] and found("deep") == [] and found("y") == [0, 1]
    assert found("other") == [] and found("") == []


def test_threat_presence_is_one_pass(spark, events):
    df = events({"@timestamp": "2026-01-15T00:00:00Z", "threat": {"technique": {"id": "T1"}}}, {"@timestamp": "2026-01-15T00:00:00Z"}, {"@timestamp": "2026-01-15T00:00:00Z"})
    out = D.threat_presence(df)
    assert {r.has_threat: r.events for r in out.collect()} == {True: 1, False: 2}
    assert {True: D.with_threat_info(df).count(), False: D.with_threat_info(df, False).count()} == {True: 1, False: 2}
    assert out.where(F.col("has_threat")).count() == 1
