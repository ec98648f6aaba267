"""The literal automaton: rules whose texts were not met cannot hit, and hits are the same with and without it."""

import json
import random

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import detect as X
from emberwatch.operators import literals as L
from emberwatch.sources.samples import grid_rules
from tests.test_rules import CASES, proc, rule

pytestmark = pytest.mark.skipif(not L.available(), reason="needs the automaton library")

WORDS = ["curl", "wget", "http://a", "-enc", "Straße", "ünder", "passwd", "/tmp/x", "a.b", "İx", "ΣΑΣ", "it's", "x\\y", "%TEMP%", "10.0.0.1", "aGk=", "-nop", "/nop", "–nop", "zz"]


def commands(rnd, n):
    return [" ".join(rnd.choice([str.upper, str.lower, str])(rnd.choice(WORDS)) for _ in range(rnd.randint(1, 5))) for _ in range(n)]


def random_rules(rnd, n):
    mods = ["", "|contains", "|startswith", "|endswith", "|contains|all", "|re", "|cased", "|contains|cased", "|base64", "|base64offset|contains", "|windash|contains",
            "|cidr", "|exists", "|gt", "|fieldref"]

    def block():
        out = {}
        for _ in range(rnd.randint(1, 3)):
            field, mod = rnd.choice(["CommandLine", "Image", "User", "nofield"]), rnd.choice(mods)
            words = [rnd.choice(WORDS + ["*" + rnd.choice(WORDS), rnd.choice(WORDS) + "*", "c?rl", None]) for _ in range(rnd.randint(1, 3))]
            if mod == "|re":
                words = [rnd.choice([r"cur[lk]+\s", "(wget|curl) ", "http://.", "a\\.b", "pass(wd)?x?", "(?i)CURL", "[a-z]{3,}zz", "(?:it's)+"])]
            elif mod == "|cidr":
                words = ["10.0.0.0/8"]
            elif mod == "|exists":
                words = ["true"]
            elif mod == "|gt":
                words = [5]
            elif mod == "|fieldref":
                words = "Image"
            elif mod:
                words = [w for w in words if w is not None] or ["curl"]
            out[field + mod] = words if rnd.random() < 0.7 or isinstance(words, str) else words[0]
        return out

    out = []
    for i in range(n):
        names = {f"s{k}": block() if rnd.random() < 0.7 else [block(), block()] for k in range(rnd.randint(1, 3))}
        if rnd.random() < 0.2:
            names["s0"] = ["curl", "passwd*x", "ünder"]
        condition = rnd.choice(["s0", "1 of s*", "all of s*", "not s0", "s0 and not s1", "s0 or s1", "2 of s*", "1 of them", "s0 and (s1 or not s2)"])
        out.append(rule(f"r{i}", {**names, "condition": condition}, product=rnd.choice(["linux", "windows", None]), category=rnd.choice(["process_creation", None])))
    return out


@pytest.mark.parametrize("semantics", ["strict", "reference"])
def test_hits_are_the_same(spark, events, semantics):
    rnd = random.Random(5)
    rules = random_rules(rnd, 60) + [rule(n, d) for n, d, *_ in CASES]
    docs = [proc(c, exe=rnd.choice(["/usr/bin/curl", "C:\\x\\wget", "passwd"]), **({"user": {"name": rnd.choice(WORDS)}} if rnd.random() < 0.5 else {}))
            for c in commands(rnd, 150) + ["x ABC y", "foo zzz", ""]]
    for d in docs[::3]:
        d["event"]["dataset"] = "windows"
    df = events(*docs)
    plain = {r.seq: [h.pos for h in r.hits] for r in X.annotate(df, rules, semantics, prefilter=False).select("seq", "hits").collect()}
    quick = {r.seq: [h.pos for h in r.hits] for r in X.annotate(df, rules, semantics, prefilter=True).select("seq", "hits").collect()}
    assert quick == plain and len({h for v in plain.values() for h in v}) > (20 if semantics == "strict" else 5)
    strict = semantics == "strict"
    predicates, _ = X.compile_rules(rules, strict, X.Fields(strict))
    assert sum(bool(p.needs) for p in predicates.values()) > 20


def test_texts_of_regular_expressions():
    flat = lambda p: [t for need in L.of_regex(p) for t in need]
    assert flat(r"Cur[lk]+\sevil\.Example") == ["cur", "evil.example"]
    assert flat("(?:abc)+def?") == ["abc"]
    assert flat("abc|def") == [] and flat("(abc|def)xyz") == ["xyz"] and flat("(abc)?xy") == [] and flat("[[a]bcd]") == [] and flat(r"\Qabc\E") == []
    assert flat("a{0,3}bcd") == ["bcd"]


def test_index_of_many_rules():
    rules = grid_rules()
    predicates, skipped = X.compile_rules(rules, True, X.Fields(True))
    index = L.LiteralIndex(predicates, {p: rules[p].product for p in predicates})
    assert len(rules) == 3600 and not skipped and not index.rest
    assert sorted(p for s in index.slots for p in s) == list(range(3600)) and max(map(len, index.slots)) <= L.SLOT
    index.build()
    met = index.met("\x01m0_low\x02c:\\windows\\agent001.exe\x03\x01m1_low\x02agent001 -enc\x03")
    assert 0 < met.bit_count() <= 4
    hit = [rules[p].id for b in range(len(index.slots)) if met >> b & 1 for p in index.slots[b]]
    assert "grid-013-00" in hit


def test_many_rules_hit_what_they_ask_for(spark, events):
    rules = grid_rules()
    wanted = rules[:144:5] + rules[1200:1500:50]
    docs = []
    for r in wanted:
        image, parts = r.detection["selection_image"]["Image|endswith"], r.detection["selection_line"]["CommandLine|contains|all"]
        docs.append(json.loads(json.dumps(proc("run " + " ".join(parts), exe="x" + image))))
        docs[-1]["event"]["dataset"] = "windows" if r.product == "windows" else "auditd"
    docs.append(proc("quiet0 -enc", exe="/bin/bash"))
    rows = X.annotate(events(*docs), rules).orderBy("seq").select(F.col("hits.rule_id").alias("ids")).collect()
    for r, row in zip(wanted, rows):
        assert r.id in row.ids
    assert rows[-1].ids == []
