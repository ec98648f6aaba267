"""SQL text shared by the twins: the unified events as a flat relation, labels and scores."""

from __future__ import annotations

from emberwatch.operators import labels as L
from emberwatch.sources import tables as A


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"


def at(values, index: str) -> str:
    """List entry at a zero-based index, '' as NULL."""
    body = f"({lst(values)})[({index}) + 1]"
    return f"NULLIF({body}, '')" if isinstance(values[0], str) else body


def isin(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def any_in(column: str, needles) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(n)})" for n in needles) + ")"


def cases(column: str, table, part: int = 1) -> str:
    """CASE over regular expressions; ``part`` picks label, severity or technique."""
    whens = " ".join(
        f"WHEN regexp_matches({column}, {q(row[0])}, 'i') THEN {q(row[part]) if isinstance(row[part], str) else row[part]}"
        for row in table)
    return f"(CASE {whens} END)"


_CATEGORY = " ".join(f"WHEN {q(t)} THEN {q(c)}" for t, c in A.CATEGORIES.items())

EVENTS = f"""
base AS (
  SELECT event_id AS seq, ts, user_id AS uid, event_type, value, props,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
         CASE event_type {_CATEGORY} END AS category
  FROM events
), sets AS (
  SELECT *, CASE category
      WHEN 'process' THEN {at(["windows", "auditd", "cowrie"], "k % 3")}
      WHEN 'network' THEN {at(["zeek.dns", "zeek.conn", "zeek.http"], "k % 3")}
      WHEN 'authentication' THEN {at(["cowrie", "windows"], "k % 2")}
      WHEN 'file' THEN {at(["auditd", "windows"], "k % 2")}
      ELSE 'mem_scanner' END AS dataset
  FROM base
), ev AS (
  SELECT seq, ts, uid, k, event_type, value, props, category, dataset,
    'case-' || uid AS case_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso_ts,
    'ev-' || seq AS eid,
    CASE WHEN category = 'process' AND dataset = 'cowrie' THEN 'input' WHEN category = 'process' THEN 'process_started'
         WHEN category = 'network' THEN 'network_flow' WHEN category = 'authentication' THEN 'login'
         WHEN category = 'file' THEN {at(A.FILE_ACTIONS, "k % 5")} ELSE 'anomaly_detected' END AS action,
    CASE WHEN CAST(floor(value) AS BIGINT) % 2 = 1 THEN 'failure' ELSE 'success' END AS outcome,
    k % 11 AS reported,
    '10.0.' || (uid % 8) || '.' || (k % 250) AS src_ip,
    40000 + k * 7 AS src_port,
    CASE WHEN category IN ('network', 'authentication') THEN '172.16.' || (uid % 4) || '.' || (k % 20) END AS dst_ip,
    CASE WHEN category = 'network' THEN {at(A.PORTS, "k % 4")} END AS dst_port,
    'host-' || (uid % 20) AS host, 'h' || (uid % 20) AS hostname, '192.168.0.' || (uid % 20) AS host_ip,
    CASE WHEN category <> 'authentication' THEN 1000 + uid END AS pid,
    CASE WHEN category <> 'authentication' THEN 1000 + uid % 20 END AS ppid,
    CASE WHEN category = 'process' THEN {at(A.PROCESSES, "k % 12")} END AS proc,
    CASE WHEN category = 'process' THEN {at(A.EXECUTABLES, "k % 12")} END AS exe,
    CASE WHEN category = 'process' THEN {at(A.COMMANDS, "k % 12")} END AS cmd,
    CASE WHEN category = 'file' THEN {at(A.FILES, "k % 10")} END AS path,
    CASE WHEN category = 'file' THEN regexp_extract({at(A.FILES, "k % 10")}, '[^/]*$') END AS file_name,
    CASE WHEN category = 'file' THEN {at(A.EXTENSIONS, "k % 10")} END AS ext,
    CASE WHEN category = 'network' THEN {at(A.PROTOCOLS, "k % 5")} END AS proto,
    CASE WHEN category = 'network' THEN {at(A.DIRECTIONS, "k % 3")} END AS direction,
    CASE WHEN k % 10 = 0 THEN 'root' WHEN k % 10 = 1 THEN 'www-data' ELSE 'u' || uid END AS user_name,
    CASE WHEN k % 16 < 8 THEN {at(A.TECHNIQUES, "k % 8")} END AS technique,
    CASE WHEN k % 16 < 8 THEN {at(A.TACTICS, "k % 8")} END AS tactic,
    CASE WHEN k % 5 = 0 THEN k / 100.0 END AS confidence,
    {at(A.SEVERITIES, "k % 7")} AS det_severity,
    event_type || ' ' || props AS message,
    CASE WHEN category = 'memory' THEN {at(A.ANOMALIES, "k % 5")} END AS a1_type,
    CASE WHEN category = 'memory' THEN {at(A.RISKS, "k % 4")} END AS a1_risk,
    CASE WHEN category = 'memory' AND k % 3 = 0 THEN 'STACK_EXEC' END AS a2_type,
    CASE WHEN category = 'memory' AND k % 3 = 0 THEN {at(["HIGH", "CRITICAL"], "k % 2")} END AS a2_risk,
    k % 25 = 7 AS tagged
  FROM sets
)
"""

_RANK = "CASE {0} WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"
_MEM = "CASE {0} " + " ".join(f"WHEN {q(k)} THEN {q(v[0])}" for k, v in L.MEMORY_LABELS.items()) + (
    " ELSE CASE {1} WHEN 'CRITICAL' THEN 'CRITICAL_MEMORY_ANOMALY' WHEN 'HIGH' THEN 'HIGH_RISK_MEMORY_ANOMALY' END END")

LABELS = f"""
lab AS (
  SELECT *, CASE
    WHEN category = 'memory' THEN COALESCE(
      CASE WHEN a2_type IS NOT NULL AND {_RANK.format('a2_risk')} < {_RANK.format('a1_risk')}
           THEN COALESCE({_MEM.format('a2_type', 'a2_risk')}, {_MEM.format('a1_type', 'a1_risk')})
           ELSE COALESCE({_MEM.format('a1_type', 'a1_risk')}, {_MEM.format('a2_type', 'a2_risk')}) END, 'MEMORY_ANOMALY')
    WHEN {any_in("COALESCE(path, '')", L.SENSITIVE_FILES)} OR {any_in("COALESCE(cmd, '')", L.SENSITIVE_FILES)} THEN 'SENSITIVE_FILE'
    WHEN {any_in("path", L.WEB_DIRECTORIES)} AND (ext IN {isin(L.WEB_EXTENSIONS)} OR contains(path, '.php'))
      THEN CASE WHEN action IN {isin(L.WEB_WRITES)} THEN 'PHP_SCRIPT' ELSE 'WEB_ROOT_ACCESS' END
    WHEN {any_in("path", L.TEMP_DIRECTORIES)} THEN 'TEMP_FILE_ACCESS'
    WHEN direction = 'inbound' THEN 'NETWORK_Inbound'
    WHEN direction = 'outbound' THEN 'NETWORK_Outbound'
    ELSE COALESCE(
      CASE WHEN category = 'network' THEN {cases('proto', L.PROTOCOL_LABELS)} END,
      CASE WHEN category = 'file' THEN {cases('path', L.FILE_LABELS)} END,
      {cases('cmd', L.COMMAND_LABELS)}, {cases('exe', L.EXECUTABLE_LABELS)}, {cases("'/' || proc", L.EXECUTABLE_LABELS)},
      {cases('path', L.FILE_LABELS)}, {cases('proto', L.PROTOCOL_LABELS)},
      upper(category) || '_' || upper(action)) END AS label
  FROM ev
)
"""

SCORES = """
parts AS (
  SELECT *, lower(COALESCE(cmd, '')) AS c, lower(COALESCE(proc, '')) AS p, lower(COALESCE(path, '')) AS f,
    CASE WHEN a1_risk = 'CRITICAL' OR a2_risk = 'CRITICAL' THEN 100 WHEN a1_risk = 'HIGH' OR a2_risk = 'HIGH' THEN 90 ELSE 0 END AS mem,
    CASE det_severity WHEN 'critical' THEN 100 WHEN 'high' THEN 80 WHEN 'medium' THEN 50 WHEN 'low' THEN 20 ELSE 0 END AS rul
  FROM ev
), flags AS (
  SELECT *, greatest(mem, rul) AS base_score,
    category = 'authentication' AND outcome = 'failure' AS auth_fail,
    category = 'authentication' AND user_name = 'root' AND outcome = 'success' AS root_in,
    dataset = 'cowrie' AS pot,
    contains(c, 'bash -i') OR contains(c, '/dev/tcp/') AS h_shell,
    contains(p, 'ncat') OR contains(p, 'nc') OR contains(p, 'socket') AS h_tool,
    contains(p, 'wget') OR contains(p, 'curl') AS h_down,
    user_name = 'www-data' AND (contains(p, 'curl') OR contains(p, 'wget') OR contains(p, 'python') OR contains(p, 'perl') OR contains(p, 'php')) AS h_low,
    (contains(f, '/var/www/html') OR contains(c, '/var/www/html'))
      AND (regexp_matches(f, '\\.(php|jsp|asp)') OR regexp_matches(c, '\\.(php|jsp|asp)')) AS h_web,
    regexp_matches(f, '/etc/(shadow|passwd|sudoers)') OR regexp_matches(c, '/etc/(shadow|passwd|sudoers)') AS h_sens,
    contains(f, '/etc/cron.d/') OR contains(f, '/etc/rc.local') OR contains(f, 'systemd/system') AS h_pers,
    dataset = 'windows' AND contains(p, 'powershell') AND contains(c, '-enc') AS h_enc,
    dataset = 'windows' AND contains(p, 'certutil') AND contains(c, '-urlcache') AS h_cert
  FROM parts
), sums AS (
  SELECT *,
    greatest(base_score, CASE WHEN reported * 10 > base_score THEN reported * 10 ELSE 0 END,
      CASE WHEN auth_fail THEN 40 ELSE 0 END, CASE WHEN root_in THEN 60 ELSE 0 END,
      CASE WHEN NOT pot THEN 0 WHEN action = 'input' THEN 75 WHEN action = 'login' AND outcome = 'success' THEN 60
           WHEN action = 'login' THEN 40 ELSE 25 END) AS plain,
    greatest(CASE WHEN h_shell THEN 85 ELSE 0 END, CASE WHEN h_tool THEN 70 ELSE 0 END, CASE WHEN h_down THEN 60 ELSE 0 END,
      CASE WHEN h_low THEN 75 ELSE 0 END, CASE WHEN h_web THEN 90 ELSE 0 END, CASE WHEN h_sens THEN 70 ELSE 0 END,
      CASE WHEN h_pers THEN 70 ELSE 0 END, CASE WHEN h_enc THEN 70 ELSE 0 END, CASE WHEN h_cert THEN 65 ELSE 0 END) AS heur
  FROM flags
), whys AS (
  SELECT *, greatest(plain, heur) AS score,
    [CASE WHEN a1_risk = 'CRITICAL' THEN 'MemDefense: Critical Anomaly (' || a1_type || ')' END,
     CASE WHEN a2_risk = 'CRITICAL' THEN 'MemDefense: Critical Anomaly (' || a2_type || ')' END,
     CASE WHEN a1_risk = 'HIGH' THEN 'MemDefense: High Risk Anomaly (' || a1_type || ')' END,
     CASE WHEN a2_risk = 'HIGH' THEN 'MemDefense: High Risk Anomaly (' || a2_type || ')' END,
     'Sigma Rule: ' || upper(det_severity),
     CASE WHEN reported > 0 AND reported * 10 > base_score THEN 'Agent Reported Severity: ' || reported END,
     CASE WHEN auth_fail THEN 'Authentication: Login Failure' END,
     CASE WHEN root_in THEN 'Authentication: Root Remote Login from ' || src_ip END,
     CASE WHEN NOT pot THEN NULL WHEN action = 'input' THEN 'HIGH: Honeypot Command Execution'
          WHEN action = 'login' AND outcome = 'success' THEN 'MEDIUM: Honeypot Login Success'
          WHEN action = 'login' THEN 'LOW: Honeypot Login Attempt' ELSE 'LOW: Honeypot Interaction' END] AS r_plain,
    [CASE WHEN h_shell THEN 'Heuristic: Reverse Shell Pattern' END,
     CASE WHEN h_tool THEN 'Heuristic: Dangerous Tool (' || p || ')' END,
     CASE WHEN h_down THEN 'Heuristic: Suspicious Tool (' || p || ')' END,
     CASE WHEN h_low THEN 'Heuristic: Low-Priv User Web Request' END,
     CASE WHEN h_web AND contains(c, '/var/www/html') THEN 'Heuristic: WebShell Pattern' WHEN h_web THEN 'Heuristic: WebShell Write' END,
     CASE WHEN h_sens THEN 'Heuristic: Sensitive/Persistence File Access' END,
     CASE WHEN h_pers THEN 'Heuristic: Persistence Mechanism Modification' END,
     CASE WHEN h_enc THEN 'Heuristic: PowerShell Encoded Command' END,
     CASE WHEN h_cert THEN 'Heuristic: Certutil Download (LotL)' END] AS r_heur
  FROM sums
), scored AS (
  SELECT *, CASE WHEN score >= 90 THEN 'critical' WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS severity,
    score >= 50 AS is_threat,
    array_to_string(list_sort(list_distinct([r FOR r IN (CASE WHEN heur > plain THEN r_plain || r_heur ELSE r_plain END) IF r IS NOT NULL])), '|') AS reasons
  FROM whys
)
"""

TACTIC = """CASE
  WHEN regexp_matches(lower(reasons), 'authentication|login|bruteforce') THEN 'Credential Access'
  WHEN regexp_matches(lower(reasons), 'webshell|persistence') THEN 'Persistence'
  WHEN regexp_matches(lower(reasons), 'shell|execution|powershell|process') THEN 'Execution'
  WHEN contains(lower(reasons), 'honeypot') THEN 'Collection'
  WHEN regexp_matches(lower(reasons), 'download|curl|wget') THEN 'Command and Control'
  WHEN regexp_matches(lower(reasons), 'scan|recon') THEN 'Reconnaissance'
  ELSE 'Initial Access' END"""

SEEDS = f"""
seed AS (
  SELECT s.* EXCLUDE (det_severity, confidence, tactic), severity AS det_severity, greatest(score, 10) / 100.0 AS confidence,
         COALESCE(tactic, {TACTIC}) AS tactic
  FROM scored s WHERE score >= 50 OR dataset = 'cowrie'
)
"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts) + " "


FLAGGED = "(COALESCE(confidence >= 0.5, FALSE) OR dataset = 'cowrie' OR tagged)"
