"""Rule detection: every rule becomes one SQL predicate that Spark evaluates with the rest of the plan.

Two semantics exist. ``reference`` keeps the behaviour existing rule results were
produced with, including the constructs it ignores. ``strict`` (default) honours
the whole rule language.
"""

from __future__ import annotations

import ast
import base64
import ipaddress
import json
import re
from collections import defaultdict
from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.columns import glob_to_regex, literal
from emberwatch.functions.sizing import broadcast_if_small
from emberwatch.operators import fields as FM
from emberwatch.operators.literals import WORD, LiteralIndex, Pred, all_of, anchored, any_of, available, like, longest, never, of_regex, pred

# A rule set is code: it is compiled on the driver. This is a hard limit of one compilation; beyond it nothing runs.
MAX_RULES = 50_000
CHUNK = 100
# Rule sets above this size are searched for the texts of their rules first.
PREFILTER_RULES = 200
DASHES = ["-", "/", "–", "—", "―"]
KNOWN_MODIFIERS = ["contains", "startswith", "endswith", "base64", "re", "cidr"]


@dataclass
class Rule:
    id: str
    title: str
    level: str
    product: str | None
    category: str | None
    service: str | None
    detection: dict
    tactics: list
    techniques: list


def collect_rules(rules: DataFrame) -> list[Rule]:
    """Rule rows as objects in file order; refuses more than ``MAX_RULES``."""
    rows = rules.orderBy("file_path", "id").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return [Rule(r.id, r.title, r.level, r.product or None, r.category or None, r.service or None,
                 json.loads(r.detection_json), list(r.tactics), list(r.techniques)) for r in rows]


# --------------------------------------------------------------------------- placeholders

MAX_PLACEHOLDER_VALUES = 100_000
_PLACEHOLDER = re.compile(r"%(\w+)%")


def collect_placeholders(values: DataFrame) -> dict[str, list[str]]:
    """A table of ``name, value`` as lists by name; refuses more than ``MAX_PLACEHOLDER_VALUES`` values. Null names and values say nothing."""
    rows = values.where("name is not null and value is not null").select("name", "value").distinct().orderBy("name", "value").limit(MAX_PLACEHOLDER_VALUES + 1).collect()
    if len(rows) > MAX_PLACEHOLDER_VALUES:
        raise ValueError(f"more than {MAX_PLACEHOLDER_VALUES} placeholder values")
    out = defaultdict(list)
    for r in rows:
        out[r.name].append(r.value)
    return dict(out)


def _filled_in(text: str, values: dict[str, list[str]]) -> list[str]:
    """A text once for every combination of values of the placeholders in it; a name without values leaves nothing."""
    names = list(dict.fromkeys(_PLACEHOLDER.findall(text)))
    return [_PLACEHOLDER.sub(lambda m: chosen[m[1]], text)
            for chosen in (dict(zip(names, c)) for c in product(*[values.get(n, []) for n in names]))]


def with_placeholders(rules: list[Rule], values: dict[str, list[str]]) -> list[Rule]:
    """Rules whose ``expand`` fields hold the values of their placeholders.

    A field that is left without any value keeps its modifier, and strict compilation
    skips the rule with that reason.
    """

    def fill(block):
        if isinstance(block, list):
            return [fill(b) for b in block]
        if not isinstance(block, dict):
            return block
        out = {}
        for spec, pattern in block.items():
            mods = spec.split("|")
            if "expand" in mods[1:]:
                listed = pattern if isinstance(pattern, list) else [pattern]
                found = [v for p in listed for v in (_filled_in(p, values) if isinstance(p, str) else [p])]
                if found:
                    spec, pattern = "|".join(m for m in mods if m != "expand"), found
            out[spec] = pattern
        return out

    return [replace(r, detection={n: b if n == "condition" else fill(b) for n, b in r.detection.items()}) for r in rules]


# --------------------------------------------------------------------------- values


def _like_text(field: str, pattern: str) -> Pred:
    """Equality without case; ``*`` makes it a wildcard for the whole text."""
    p = pattern.lower()
    if "*" in p:
        core = p.strip("*")
        if core and not re.search(r"[*?\[]", core):
            head, tail = p.startswith("*"), p.endswith("*")
            op = "contains" if head and tail else "endswith" if head else "startswith"
            return _has(op, field, core)
        return pred(f"{field} rlike {literal(glob_to_regex(p))}", None if "[" in p else longest(re.split(r"[*?]", p)))
    return _has("=", field, p)


def _has(op: str, field: str, value: str, low: str | None = None) -> Pred:
    """``value`` equals, starts, ends or is contained in ``field``; ``low`` is the lowered column where ``field`` is the raw one."""
    sql = f"{field} = {literal(value)}" if op == "=" else f"{op}({field}, {literal(value)})"
    name = low or field
    need = longest([value]) if op == "contains" else anchored(name, value, op != "endswith", op != "startswith")
    return pred(sql, need)


def _strict_like(field: str, pattern: str, kind: str) -> Pred:
    """Wildcards of the rule language: ``*`` and ``?``, a backslash makes them literal."""
    p = pattern.lower()
    if not re.search(r"[*?]", p):
        return _has(kind if kind in ("contains", "startswith", "endswith") else "=", field, p)
    parts, i, texts = [], 0, [""]
    while i < len(p):
        if p[i] == "\\" and i + 1 < len(p) and p[i + 1] in "*?":
            parts.append(re.escape(p[i + 1]))
            texts[-1] += p[i + 1]
            i += 2
            continue
        parts.append({"*": ".*", "?": "."}.get(p[i], re.escape(p[i])))
        if p[i] in "*?":
            texts.append("")
        else:
            texts[-1] += p[i]
        i += 1
    body = "".join(parts)
    left = "" if kind in ("contains", "endswith") else "^"
    right = "" if kind in ("contains", "startswith") else "$"
    return pred(f"{field} rlike {literal('(?s)' + left + body + right)}", longest(texts))


def _cidr6(field: str, net: ipaddress.IPv6Network) -> str:
    """Whether a v6 address, compressed or not, lies in a network: its 32 hex digits are written out and compared. Dotted tails match nothing."""
    f = f"lower({field})"
    left, right = (f"coalesce(filter(split(try_element_at(split({f}, '::'), {i}), ':'), x -> x <> ''), cast(array() AS array<string>))" for i in (1, 2))
    zeros = f"array_repeat('0', if(contains({f}, '::'), 8 - size({left}) - size({right}), 0))"
    digits = f"array_join(transform(concat({left}, {zeros}, {right}), x -> lpad(x, 4, '0')), '')"
    whole, bits = divmod(net.prefixlen, 4)
    want = net.network_address.exploded.replace(":", "")
    tests = [f"{f} rlike '^[0-9a-f:]*:[0-9a-f:]*$'", f"length({digits}) = 32", f"startswith({digits}, {literal(want[:whole])})"]
    if bits:
        first = int(want[whole], 16)
        among = ", ".join(f"'{n:x}'" for n in range(first, first + (1 << (4 - bits))))
        tests.append(f"substring({digits}, {whole + 1}, 1) IN ({among})")
    return "(" + " AND ".join(tests) + ")"


def _cidr(field: str, pattern: str) -> str:
    net = ipaddress.ip_network(pattern, strict=False)
    if net.version == 6:
        return _cidr6(field, net)
    lo, hi = int(net.network_address), int(net.broadcast_address)
    octets = [f"try_cast(split({field}, '[.]')[{i}] AS BIGINT) * {256 ** (3 - i)}" for i in range(4)]
    number = " + ".join(octets)
    return f"({field} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' AND ({number}) BETWEEN {lo} AND {hi})"


def _regex(pattern: str, mods: list[str], ignore_case: bool) -> str:
    flags = "i" if ignore_case or "i" in mods else ""
    flags += "m" if "m" in mods else ""
    flags += "s" if "s" in mods else ""
    body = pattern.replace("(?P<", "(?<")
    return f"(?{flags}){body}" if flags else body


def _one(raw: str, low: str, pattern, mods: list[str], strict: bool) -> Pred:
    """Predicate for one value. ``raw`` and ``low`` are the field as it is and lowered."""
    # blank text counts as missing everywhere, so an empty value asks for the same
    if strict and (pattern is None or (pattern == "" and not mods)):
        return pred(f"{raw} IS NULL")
    text = str(pattern)
    if not strict:
        for mod in mods:
            if mod in ("contains", "startswith", "endswith"):
                return _has(mod, low, text.lower())
            if mod == "base64":
                return _has("contains", raw, text, low)
            if mod == "re":
                return pred(f"{raw} rlike {literal(_regex(text, [], True))}", *of_regex(text))
            if mod == "cidr":
                if "/" not in text:
                    return _has("=", raw, text, low)
                return _has("startswith", raw, text.split("/")[0].rsplit(".", 1)[0], low)
        return _like_text(low, text)

    if "cidr" in mods:
        return pred(_cidr(raw, text))
    if "re" in mods:
        return pred(f"{raw} rlike {literal(_regex(text, mods, False))}", *of_regex(text))
    if "exists" in mods:
        return pred(f"{raw} IS {'NOT ' if text.lower() == 'true' else ''}NULL")
    for mod, op in (("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):
        if mod in mods:
            return pred(f"try_cast({raw} AS DOUBLE) {op} {float(pattern)}")
    kind = next((m for m in mods if m in ("contains", "startswith", "endswith")), "")
    variants = [text]
    if "windash" in mods:
        variants = list(dict.fromkeys(re.sub(r"(^|(?<=\s))[-/]", lambda m: d, v) for v in variants for d in DASHES))
    wide = any(m in mods for m in ("wide", "utf16le"))
    coded = [v.encode("utf-16-le" if wide else "utf-8") for v in variants]
    if "base64offset" in mods:
        pieces = []
        for b in coded:
            for off in range(3):
                enc = base64.b64encode(b" " * off + b).decode()
                start = (0, 2, 3)[off]
                stop = {0: None, 1: -3, 2: -2}[(len(b) + off) % 3]
                pieces.append(enc[start:stop])
        return _or([_has("contains", raw, p, low) for p in pieces])
    if "base64" in mods:
        return _or([_has("contains" if kind == "contains" else "=", raw, base64.b64encode(b).decode(), low) for b in coded])
    if "cased" in mods:
        return _or([_has(kind or "=", raw, v, low) for v in variants])
    preds = [_strict_like(low, v, kind) for v in variants]
    return preds[0] if len(preds) == 1 else _or(preds)


def _or(preds: list[str]) -> Pred:
    return any_of(preds, "(" + " OR ".join(preds) + ")")


def _and(preds: list[str]) -> Pred:
    return all_of(preds, "(" + " AND ".join(preds) + ")")


def _field_predicate(resolve, spec: str, pattern, strict: bool) -> Pred:
    name, *mods = spec.split("|")
    if strict and "expand" in mods:
        raise ValueError(f"no values for the placeholders of {name}")
    if strict and "fieldref" in mods:
        a, b = resolve(name), resolve(str(pattern))
        if a is None or b is None:
            return never()
        kind = next((m for m in mods if m in ("contains", "startswith", "endswith")), "")
        return pred(f"coalesce({kind}({a[1]}, {b[1]}), false)" if kind else f"coalesce({a[1]} = {b[1]}, false)")
    pair = resolve(name)
    if pair is None:
        values = pattern if isinstance(pattern, list) else [pattern]
        return pred("true") if strict and None in values else never()
    raw, low = pair
    every = "all" in mods
    rest = [m for m in mods if m != "all"] if isinstance(pattern, list) and every else mods
    values = pattern if isinstance(pattern, list) else [pattern]
    if not values:
        return pred("true") if every else never()
    joined = (_and if every else _or)([_one(raw, low, v, rest, strict) for v in values])
    return like(f"coalesce({joined}, false)", joined)


def _keywords(values, every: bool, strict_text: str) -> Pred:
    joined = (_and if every else _or)([_strict_like(strict_text, str(v), "contains") for v in values])
    return like(f"coalesce({joined}, false)", joined)


def _map_predicate(resolve, block: dict, strict: bool) -> Pred:
    preds = []
    for spec, pattern in block.items():
        if strict and spec.split("|")[0] == "":
            vals = pattern if isinstance(pattern, list) else [pattern]
            preds.append(_keywords(vals, "all" in spec.split("|"), "m_text"))
        else:
            preds.append(_field_predicate(resolve, spec, pattern, strict))
    return _and(preds) if preds else pred("true")


def _block(resolve, block, strict: bool) -> Pred | None:
    """Predicate of one named block, None when its shape is not evaluated."""
    if isinstance(block, dict):
        return _map_predicate(resolve, block, strict)
    if not strict:
        return None
    items = block if isinstance(block, list) else [block]
    maps = [_map_predicate(resolve, b, True) for b in items if isinstance(b, dict)]
    words = [b for b in items if not isinstance(b, dict)]
    if words:
        maps.append(_keywords(words, False, "m_text"))
    return _or(maps)


# --------------------------------------------------------------------------- conditions

_QUANTIFIED = re.compile(r"(\d+|all|any)\s+of\s+(\w+\*?)", re.I)


def _count(preds: list[str], amount: str) -> Pred:
    if not preds:
        return never()
    if amount == "all":
        return _and(preds)
    n = 1 if amount == "any" else int(amount)
    if n == 1:
        return _or(preds)
    sql = "((" + " + ".join(f"cast({p} AS INT)" for p in preds) + f") >= {n})"
    return any_of(preds, sql) if n else pred(sql)


UNDEFINED = never("CAST(NULL AS BOOLEAN)")


def _boolean(node, names: dict[str, str]) -> tuple[Pred, bool]:
    """SQL of a Python boolean expression, and whether it can be undefined.

    An undefined name makes the left-to-right evaluation fail, which is written
    as NULL; operands before it can still decide, and NULL wins over later ones.
    """
    if isinstance(node, ast.Expression):
        return _boolean(node.body, names)
    if isinstance(node, ast.BoolOp):
        conj = isinstance(node.op, ast.And)
        parts = [_boolean(v, names) for v in node.values]
        join = all_of if conj else any_of
        if not any(loose for _, loose in parts):
            return join([p for p, _ in parts], "(" + (" AND " if conj else " OR ").join(p for p, _ in parts) + ")"), False
        out = parts[-1][0]
        for p, _ in reversed(parts[:-1]):
            decided = f"NOT {p} THEN false" if conj else f"{p} THEN true"
            out = f"CASE WHEN {p} IS NULL THEN {UNDEFINED} WHEN {decided} ELSE {out} END"
        return join([p for p, _ in parts], f"({out})"), True
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        inner, loose = _boolean(node.operand, names)
        return pred(f"(NOT {inner})"), loose
    if isinstance(node, ast.Name):
        return names.get(node.id, UNDEFINED), node.id not in names
    raise ValueError("unsupported condition")


def _condition(condition, blocks: dict[str, str], strict: bool) -> Pred:
    if isinstance(condition, list):
        if not strict:
            return never()
        return _or([_condition(c, blocks, strict) for c in condition])
    text = str(condition).strip()
    if not strict:
        lead = re.match(r"(\d+|all)\s+of\s+(\w+)\*", text)
        if lead:
            return _count([p for n, p in blocks.items() if n.startswith(lead[2])], lead[1])
        guard = re.match(r"(\w+)\s+and\s+not\s+(\d+|all)\s+of\s+(\w+)\*", text)
        if guard:
            group = _count([p for n, p in blocks.items() if n.startswith(guard[3])], guard[2])
            first = blocks.get(guard[1], never())
            return like(f"({first} AND NOT {group})", first)
        try:
            found = _boolean(ast.parse(text, mode="eval"), blocks)[0]
            return like(f"coalesce({found}, false)", found)
        except (SyntaxError, ValueError):
            return never()

    if "|" in text:
        raise ValueError("aggregating conditions are not row predicates")
    names = dict(blocks)

    def replace(m: re.Match) -> str:
        target = m[2]
        if target.lower() == "them":
            group = list(blocks.values())
        elif target.endswith("*"):
            group = [p for n, p in blocks.items() if n.startswith(target[:-1])]
        else:
            group = [blocks[target]] if target in blocks else []
        key = f"quantified_{len(names)}"
        names[key] = _count(group, m[1].lower())
        return key

    body = _QUANTIFIED.sub(replace, text)
    body = re.sub(r"\b(AND|OR|NOT)\b", lambda m: m[1].lower(), body)
    found = _boolean(ast.parse(body, mode="eval"), names)[0]
    return like(f"coalesce({found}, false)", found)


# --------------------------------------------------------------------------- fields

class Fields:
    """Columns that rules refer to, each materialised once next to its lowered form."""

    def __init__(self, strict: bool):
        self.strict = strict
        self.columns: dict[str, Column] = {}
        self.names: dict[tuple[str, str], tuple[str, str] | None] = {}
        self.audit = FM.audit_process_fields()

    def _add(self, key: tuple[str, str], c: Column | None) -> tuple[str, str] | None:
        if c is None:
            self.names[key] = None
        else:
            n = f"m{len(self.columns)}"
            self.columns[n] = c
            self.names[key] = (n, n + "_low")
        return self.names[key]

    def _plain(self, name: str) -> Column | None:
        """Name taken as a path of the event itself."""
        direct = FM.path_column(name)
        if direct is not None or not self.strict:
            return direct
        if name in FM.WINDOWS_FIELDS:
            return FM.mapped(FM.WINDOWS_FIELDS[name] + [f"raw.{name}"])
        safe = re.fullmatch(r"[A-Za-z_][\w]*", name)
        if not safe:
            return FM.odd_key(name)
        return F.coalesce(FM.path_column(f"raw.{name}"), FM.path_column(f"raw.EventData.{name}"))

    def _table(self, table: dict, name: str) -> Column | None:
        if name in table:
            return FM.mapped(table[name])
        return self._plain(name) if self.strict else None

    def resolver(self, rule: Rule):
        def find(name: str):
            if rule.product == "windows":
                kind = "process" if rule.category == "process_creation" else "event"
            elif rule.product == "linux":
                kind = "linux_process" if rule.category == "process_creation" else "linux"
            else:
                kind = "zeek" if rule.product == "zeek" else "open"
            key = (kind, name)
            if key in self.names:
                return self.names[key]
            if kind == "process":
                c = self._table(FM.PROCESS_FIELDS, name)
            elif kind == "linux_process":
                c = self.audit.get(name, self._plain(name) if self.strict else None)
            elif kind == "zeek":
                c = self._table(FM.ZEEK_FIELDS, name)
            elif kind == "linux":
                a, b = self.audit.get(name), self._table(FM.AUDIT_FIELDS, name)
                a = b if a is None and self.strict else a
                null = F.lit(None).cast("string")
                c = None if a is None and b is None else F.when(
                    F.col("ls_audit"), null if a is None else a).otherwise(null if b is None else b)
            elif kind == "open":
                a, b = self._table(FM.HONEYPOT_FIELDS, name), self._plain(name)
                null = F.lit(None).cast("string")
                c = None if a is None and b is None else F.when(
                    F.col("ls_honeypot"), null if a is None else a).otherwise(null if b is None else b)
            else:
                c = self._plain(name)
            return self._add(key, c)

        return find

    def attach(self, df: DataFrame) -> DataFrame:
        if not self.columns:
            return df
        df = df.withColumns(self.columns)
        return df.withColumns({n + "_low": F.lower(F.col(n)) for n in self.columns})


def compile_rules(rules: list[Rule], strict: bool, fields: Fields) -> tuple[dict[int, Pred], dict[int, str]]:
    """Rule position → SQL predicate, and position → why a rule cannot be compiled. Ids may be missing or repeated."""
    out, skipped = {}, {}
    for pos, rule in enumerate(rules):
        resolve = fields.resolver(rule)
        try:
            names = [n for n in rule.detection if n not in ("condition", "timeframe" if strict else "condition")]
            names.sort(key=lambda n: n.startswith("filter"))
            blocks = {n: _block(resolve, rule.detection[n], strict) for n in names}
            blocks = {n: p for n, p in blocks.items() if p is not None}
            condition = rule.detection.get("condition", "")
            out[pos] = _condition(condition, blocks, strict) if condition else never()
        except (ValueError, SyntaxError, KeyError, TypeError) as e:
            skipped[pos] = str(e)
    return out, skipped


def _field_report(rule: Rule, fields: Fields, strict: bool) -> str:
    """map(field → value) over the fields of the blocks that matched."""
    resolve, entries = fields.resolver(rule), []
    for name, block in rule.detection.items():
        if name == "condition" or not isinstance(block, dict):
            continue
        pred = _map_predicate(resolve, block, strict)
        for spec in block:
            pair = resolve(spec.split("|")[0])
            if pair:
                entries.append(f"CASE WHEN {pred} THEN named_struct('field', {literal(spec.split('|')[0])}, 'value', {pair[0]}) END")
    if not entries:
        return "cast(array() AS array<struct<field:string,value:string>>)"
    return f"array_distinct(array_compact(array({', '.join(entries)})))"


def _guard(source: tuple) -> str:
    return " AND ".join(f"(ls_{n} IS NULL OR ls_{n} = {literal(v)})" for n, v in zip(("product", "category", "service"), source) if v)


def annotate(df: DataFrame, rules: list[Rule], semantics: str = "strict", report_fields: bool = False, prefilter: bool | None = None) -> DataFrame:
    """Adds ``hits``, the rules every event matches, without moving a row.

    Rules are grouped by log source: an event evaluates only the groups its own
    log source does not conflict with. Within a group the predicates sit in
    arrays of about a hundred so that generated methods stay compilable.

    With ``prefilter`` (by default for large rule sets) one pass over an event's fields
    finds the texts that rules cannot do without, and only the rules whose texts were met
    are evaluated. The hits are the same.
    """
    strict = semantics == "strict"
    fields = Fields(strict)
    predicates, _ = compile_rules(rules, strict, fields)
    predicates = {pos: p for pos, p in predicates.items() if p != "false" and not p.never}
    source = {pos: (rules[pos].product, rules[pos].category, rules[pos].service) for pos in predicates}
    if prefilter is None:
        prefilter = len(predicates) > PREFILTER_RULES and available()
    index = LiteralIndex(predicates, source) if prefilter else None
    if index is not None and not index.slots:
        index = None

    kind = "struct<pos:int,rule_id:string" + (",fields:array<struct<field:string,value:string>>>" if report_fields else ">")

    def tested(members: list[int]) -> str:
        items = []
        for pos in members:
            extra = f", 'fields', {_field_report(rules[pos], fields, strict)}" if report_fields else ""
            items.append(f"CASE WHEN {predicates[pos]} THEN named_struct('pos', {pos}, 'rule_id', {literal(rules[pos].id)}{extra}) END")
        return f"array_compact(array({', '.join(items)}))"

    def guarded(guard: str, arr: str) -> str:
        return f"CASE WHEN {guard} THEN {arr} ELSE array() END" if guard else arr

    groups: dict[tuple, list[int]] = defaultdict(list)
    for pos in predicates if index is None else index.rest:
        groups[source[pos]].append(pos)
    arrays = [guarded(_guard(key), tested(members[i:i + CHUNK])) for key, members in groups.items() for i in range(0, len(members), CHUNK)]

    out = FM.with_logsource(df)
    out = fields.attach(out)
    if strict:
        out = out.withColumn("m_text", F.lower(F.concat_ws(" ", F.col("message"), F.col("raw"), F.col("process.command_line"))))
    if index is not None:
        out = index.attach(out, {n: F.col(n) for n in searched(index, fields, strict)})
        for w in range(index.words):
            slots = [s for s in range(len(index.slots)) if s // WORD == w]
            met = [guarded(index.where(s) + "".join(f" AND {g}" for g in [_guard(source[index.slots[s][0]])] if g), tested(index.slots[s])) for s in slots]
            # most events meet no text of most words
            arrays.append(guarded(f"met.w{w} <> 0", f"concat({', '.join(met)})" if len(met) > 1 else met[0]))
    hits = f"array_sort(concat({', '.join(arrays)}))" if arrays else "array()"
    out = out.withColumn("hits", F.expr(f"cast({hits} AS array<{kind}>)"))
    return out.select(*df.columns, "hits")


def searched(index: LiteralIndex, fields: Fields, strict: bool) -> list[str]:
    """Lowered columns the automaton reads: those with a named text, and all others, since a contained text names no field."""
    return [f"{n}_low" for n in fields.columns] + (["m_text"] if strict else [])


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    """Attributes of the rules, as many rows as rules."""
    rows = [(i, r.id, r.title, r.level, r.product, r.category, r.service, r.tactics, r.techniques) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "pos int, rule_id string, title string, level string, product string, category string, "
                                       "service string, tactics array<string>, techniques array<string>")


def skipped_rules(spark, rules: list[Rule], semantics: str = "strict") -> DataFrame:
    """Rules that cannot be compiled and take part in nothing, with the reason."""
    strict = semantics == "strict"
    _, skipped = compile_rules(rules, strict, Fields(strict))
    rows = [(pos, rules[pos].id, rules[pos].title, why) for pos, why in skipped.items()]
    return spark.createDataFrame(rows, "pos int, rule_id string, title string, reason string")


def detect(df: DataFrame, rules: list[Rule], semantics: str = "strict", report_fields: bool = False,
           keep: list[str] | None = None) -> DataFrame:
    """One row per event and matching rule, with the rule's attributes."""
    hit = annotate(df, rules, semantics, report_fields)
    keep = keep or list(df.columns)
    # A plain explode lets Spark infer a filter on the array, which it then pushes down by
    # repeating every predicate; the outer form with a filter on the result does not.
    long = hit.select(*keep, F.explode_outer("hits").alias("h")).where(F.col("h").isNotNull())
    cols = [F.col("h.pos").alias("pos")] + ([F.col("h.fields").alias("matched_fields")] if report_fields else [])
    attrs = broadcast_if_small(rule_table(df.sparkSession, rules), rows=len(rules))
    return long.select(*keep, *cols).join(attrs, "pos")
