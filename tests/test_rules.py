"""Rule constructs in both semantics."""

import json
import os

from emberwatch.operators import detect as X
from emberwatch.operators import tagging as T
from emberwatch.plans.rule_queries import PLACEHOLDERS, STARTER
from emberwatch.sources.rules import auditd_rules, load_rules, rule_stats, select_rules, zeek_rules

T0 = "2026-01-15T11:12:45Z"


def rule(i, detection, product="linux", category="process_creation", level="high", techniques=("T1059",), tactics=("execution",), service=None):
    return X.Rule(i, f"title {i}", level, product, category, service, json.loads(json.dumps(detection)), list(tactics), list(techniques))


def proc(cmd, exe="/usr/bin/x", **kw):
    return {"@timestamp": T0, "event": {"id": cmd, "category": "process", "dataset": "auditd"}, "process": {"command_line": cmd, "executable": exe}, **kw}


CASES = [
    # name, detection, commands that match (strict), commands that match (reference)
    ("contains", {"s": {"CommandLine|contains": "abc"}, "condition": "s"}, {"x ABC y"}, {"x ABC y"}),
    ("all", {"s": {"CommandLine|contains|all": ["abc", "y"]}, "condition": "s"}, {"x ABC y"}, {"x ABC y"}),
    ("starts", {"s": {"CommandLine|startswith": "x "}, "condition": "s"}, {"x ABC y"}, {"x ABC y"}),
    ("ends", {"s": {"CommandLine|endswith": [" y", "zzz"]}, "condition": "s"}, {"x ABC y", "foo zzz"}, {"x ABC y", "foo zzz"}),
    ("equal", {"s": {"CommandLine": "foo ZZZ"}, "condition": "s"}, {"foo zzz"}, {"foo zzz"}),
    ("wild", {"s": {"CommandLine": "foo*z"}, "condition": "s"}, {"foo zzz"}, {"foo zzz"}),
    ("regex", {"s": {"CommandLine|re": "AB[A-C]"}, "condition": "s"}, {"x ABC y"}, {"x ABC y"}),
    ("regex_case", {"s": {"CommandLine|re": "abc"}, "condition": "s"}, set(), {"x ABC y"}),
    ("not", {"s": {"CommandLine|contains": ["abc", "zzz"]}, "f": {"CommandLine|contains": "foo"}, "condition": "s and not f"}, {"x ABC y"}, {"x ABC y"}),
    ("two_of", {"s1": {"CommandLine|contains": "abc"}, "s2": {"CommandLine|contains": "y"}, "s3": {"CommandLine|contains": "q"}, "condition": "2 of s*"},
     {"x ABC y"}, {"x ABC y"}),
    ("of_then_filter", {"s1": {"CommandLine|contains": "zzz"}, "filter": {"CommandLine|contains": "foo"}, "condition": "1 of s* and not filter"}, set(), {"foo zzz"}),
    ("two_filters", {"selection": {"CommandLine|contains": "zzz"}, "fa1": {"CommandLine|contains": "nope"}, "fb1": {"CommandLine|contains": "foo"},
                     "condition": "selection and not 1 of fa* and not 1 of fb*"}, set(), {"foo zzz"}),
    ("of_inside", {"a": {"CommandLine|contains": "foo"}, "s1": {"CommandLine|contains": "zzz"}, "condition": "a and 1 of s*"}, {"foo zzz"}, set()),
    ("list_of_maps", {"selection": [{"CommandLine|contains": "abc"}, {"CommandLine|contains": "zzz"}], "condition": "selection"}, {"x ABC y", "foo zzz"}, set()),
    ("keywords", {"keywords": ["abc"], "condition": "keywords"}, {"x ABC y"}, set()),
    ("null", {"s": {"CommandLine": "foo zzz", "ParentImage": None}, "condition": "s"}, {"foo zzz"}, set()),
    ("or_undefined", {"a": {"CommandLine|contains": "abc"}, "k": ["zzz"], "condition": "a or k"}, {"x ABC y", "foo zzz"}, {"x ABC y"}),
    ("undefined_first", {"a": {"CommandLine|contains": "abc"}, "k": ["zzz"], "condition": "k or a"}, {"x ABC y", "foo zzz"}, set()),
    ("them", {"a": {"CommandLine|contains": "abc"}, "b": {"CommandLine|contains": "zzz"}, "condition": "1 of them"}, {"x ABC y", "foo zzz"}, set()),
    ("windash", {"s": {"CommandLine|contains|windash": " -q"}, "condition": "s"}, {"run /q"}, set()),
    ("cased", {"s": {"CommandLine|contains|cased": "abc"}, "condition": "s"}, set(), {"x ABC y"}),
    ("missing_field", {"s": {"NoSuchField": "x"}, "condition": "s"}, set(), set()),
    ("malformed", {"s": {"CommandLine|contains": "abc"}, "condition": "s and ("}, set(), set()),
]


def test_constructs(events):
    df = events(proc("x ABC y"), proc("foo zzz"), proc("run /q"))
    rules = [rule(n, d) for n, d, _, _ in CASES]
    for mode, column in (("strict", 2), ("reference", 3)):
        hits = {}
        for r in X.detect(df, rules, mode, keep=["event"]).select("rule_id", "event.id").collect():
            hits.setdefault(r.rule_id, set()).add(r.id)
        for case in CASES:
            assert hits.get(case[0], set()) == case[column], (mode, case[0], hits.get(case[0]))


def test_cidr(events):
    doc = lambda ip: {"@timestamp": T0, "event": {"id": ip, "category": "network", "dataset": "zeek.conn"}, "source": {"ip": ip}}
    df = events(doc("10.0.1.5"), doc("10.0.0.7"), doc("10.0.2.1"))
    r = [rule("c", {"s": {"id.orig_h|cidr": "10.0.0.0/23"}, "condition": "s"}, "zeek", None)]
    got = lambda m: {x.id for x in X.detect(df, r, m, keep=["event"]).select("event.id").collect()}
    assert got("strict") == {"10.0.1.5", "10.0.0.7"}
    assert got("reference") == {"10.0.0.7"}


def test_cidr_of_long_addresses(events):
    doc = lambda ip: {"@timestamp": T0, "event": {"id": ip, "category": "network", "dataset": "zeek.conn"}, "source": {"ip": ip}}
    df = events(*map(doc, ("::1", "::2", "fd00::5", "FE80:0:0:0:0:0:0:1", "fea0::1", "fec0::1", "2001:db8::1", "10.0.0.1", "fe80")))
    got = lambda net: {x.id for x in X.detect(df, [rule("c", {"s": {"id.orig_h|cidr": net}, "condition": "s"}, "zeek", None)], keep=["event"]).select("event.id").collect()}
    assert got("::1/128") == {"::1"} and got("fc00::/7") == {"fd00::5"} and got("fe80::/10") == {"FE80:0:0:0:0:0:0:1", "fea0::1"}
    assert got("2001:db8::/32") == {"2001:db8::1"} and len(got("::/0")) == 7


def test_rules_of_equal_ids_and_skipped_rules(events, spark):
    rules = [rule("", {"s": {"CommandLine": "abc"}, "condition": "s"}), rule("", {"s": {"CommandLine": "xyz"}, "condition": "s"}),
             rule("", {"s": {"CommandLine": "abc"}, "condition": "s and ("})]
    got = sorted((r.pos, r.id) for r in X.detect(events(proc("abc"), proc("xyz")), rules, keep=["event"]).select("pos", "event.id").collect())
    assert got == [(0, "abc"), (1, "xyz")]
    assert [r.pos for r in X.skipped_rules(spark, rules).collect()] == [2]


def test_odd_field_names_and_empty_values(events):
    raw = json.dumps({"cs-uri-query": "?x=abc", "userIdentity": {"type": "Root"}, "a.b": "flat"})
    df = events(proc("c", raw=raw))
    hits = lambda block: X.detect(df, [rule("r", {"s": block, "condition": "s"})]).count()
    assert hits({"cs-uri-query|contains": "ABC"}) == 1 and hits({"cs-uri-query": "abc"}) == 0
    assert hits({"userIdentity.type": "root"}) == 1 and hits({"a.b": "flat"}) == 1 and hits({"no-such-key": "x"}) == 0
    assert hits({"no-such-key": ""}) == 1 and hits({"CommandLine": ""}) == 0


def test_field_references(events):
    make = lambda spec, other: [rule("r", {"s": {spec: other}, "condition": "s"})]
    df = events(proc("/bin/abc -x", process={"command_line": "/bin/abc -x", "executable": "/bin/abc"}))
    assert X.detect(df, make("CommandLine|fieldref|startswith", "Image")).count() == 1
    assert X.detect(df, make("CommandLine|fieldref", "Image")).count() == 0
    assert X.detect(df, make("CommandLine|fieldref", "no such field")).count() == 0


def test_unknown_logsource_keys_do_not_conflict(events):
    df = events(proc("abc"), {"@timestamp": T0, "event": {"id": "w", "category": "process", "dataset": "windows"}, "process": {"command_line": "abc"}})
    det = {"s": {"CommandLine|contains": "abc"}, "condition": "s"}
    rules = [rule("linux", det), rule("win", det, product="windows"), rule("any", det, product=None), rule("file", det, category="file_event")]
    got = {(r.rule_id, r.id) for r in X.detect(df, rules, keep=["event"]).select("rule_id", "event.id").collect()}
    assert got == {("linux", "abc"), ("any", "abc"), ("win", "w"), ("any", "w")}


def test_matched_fields(events):
    det = {"s": {"CommandLine|contains": "abc"}, "t": {"Image|endswith": "/nope"}, "condition": "s or t"}
    row = X.detect(events(proc("abc")), [rule("r", det)], report_fields=True).first()
    assert [(f.field, f.value) for f in row.matched_fields] == [("CommandLine", "abc")]


def test_loader(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "ok.yml").write_text(
        "title: A\nid: a\nlogsource: {product: linux, service: auditd}\ndetection: {s: {x: 1}, condition: s}\n"
        "tags: [attack.execution, attack.t1059, attack.g0016, other.x]\nlevel: low\n")
    (tmp_path / "broken.yml").write_text("a: [1\n")
    (tmp_path / "nodetection.yml").write_text("title: B\nlogsource: {}\n")
    rules = load_rules(spark, str(tmp_path))
    row = rules.collect()
    assert len(row) == 1 and row[0].tactics == ["execution", "g0016"] and row[0].techniques == ["T1059"]
    assert auditd_rules(rules).count() == 1 and zeek_rules(rules).count() == 0
    assert select_rules(rules, category="file_event").count() == 1
    stats = {(r.kind, r.value): r.rules for r in rule_stats(rules).collect()}
    assert stats[("product", "linux")] == 1 and stats[("category", "unknown")] == 1 and stats[("tactic", "g0016")] == 1


def test_starter_rules_compile(spark):
    rules = X.with_placeholders(X.collect_rules(load_rules(spark, STARTER)), PLACEHOLDERS)
    assert len(rules) == len([f for f in os.listdir(STARTER) if f.endswith(".yml")]) - 1
    _, skipped = X.compile_rules(rules, True, X.Fields(True))
    assert not skipped


def test_node_confidence(events):
    det = {"s": {"CommandLine|contains": "abc"}, "condition": "s"}
    low = rule("r", det, level="low")
    for n, want in ((1, 0.3), (2, 0.35), (3, 0.45), (9, 0.99)):
        docs = [proc(f"abc {i}") for i in range(n)]
        node = T.technique_nodes(T.tag_hits(X.detect(events(*docs), [low]))).first()
        assert abs(node.confidence - want) < 1e-9 and node.event_count == n and node.technique_name == "Command and Scripting Interpreter"


def test_upstream_detection_passes_through(events):
    doc = proc("nothing", threat={"technique": {"id": "T1078"}})
    row = T.analyze(events(doc), [rule("r", {"s": {"CommandLine": "q"}, "condition": "s"})]).first()
    assert row.detected and row.matched_rules == ["Upstream Detection: T1078"] and row.primary.confidence == 0.8


def test_placeholders(spark, events):
    table = spark.createDataFrame([("admins", "Root"), ("admins", "adm*"), ("tools", "nc"), ("tools", "ncat"), ("hosts", "h1"), (None, "x"), ("nothing", None), ("admins", "Root")],
                                  "name string, value string")
    values = X.collect_placeholders(table)
    assert values == {"admins": ["Root", "adm*"], "tools": ["nc", "ncat"], "hosts": ["h1"]}
    cases = {
        "plain": ({"User|expand": "%admins%"}, {"root", "admin7"}),
        "list": ({"User|expand": ["%admins%", "eve"]}, {"root", "admin7", "eve"}),
        "inside": ({"CommandLine|contains|expand": "run %tools% on %hosts%"}, {"root", "eve"}),
        "every": ({"CommandLine|contains|all|expand": ["%tools%", "%hosts%"]}, {"eve"}),
        "cased": ({"User|cased|expand": "%admins%"}, set()),
        "unknown": ({"User|expand": "%nobody%"}, None),
        "partly": ({"User|expand": ["%nobody%", "eve"]}, {"eve"}),
        "literal": ({"User|expand": "eve"}, {"eve"}),
        "nested": ([{"User|expand": "%admins%"}, {"User": "eve"}], {"root", "admin7", "eve"}),
    }
    rules = [rule(n, {"s": s, "condition": "s"}) for n, (s, _) in cases.items()]
    filled = X.with_placeholders(rules, values)
    assert rules[0].detection["s"] == {"User|expand": "%admins%"}  # the rules given stay as they are
    lines = {"root": "run nc on h1", "admin7": "run nc", "eve": "run ncat on h1", "bob": "x"}
    docs = [proc(c, process={"command_line": c, "executable": "/usr/bin/x", "user": {"name": u}}) for u, c in lines.items()]
    got = {}
    for r in X.detect(events(*docs), filled).collect():
        got.setdefault(r.rule_id, set()).add(r.process.user.name)
    assert got == {n: want for n, (_, want) in cases.items() if want}
    skipped = {r.rule_id: r.reason for r in X.skipped_rules(spark, filled).collect()}
    assert set(skipped) == {"unknown"} and "User" in skipped["unknown"]
    assert {r.rule_id for r in X.skipped_rules(spark, rules).collect()} == set(cases)
