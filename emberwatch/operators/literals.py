"""Literal automaton in front of large rule sets.

Most rule predicates can only hold where certain texts occur. ``Pred`` carries these texts
beside the SQL of a predicate; ``LiteralIndex`` searches the texts of all rules in one pass
over an event's fields, and only rules whose texts were met are evaluated exactly.

The searched text of an event is made of its lowered fields, each between a head that names
the field and an end mark, so equality and prefixes are texts with a head, suffixes texts
with an end mark. All texts are ASCII: there lowering works character by character.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, NAMED, END = "\x01", "\x02", "\x03"
#: Texts below this length say too little; clauses kept per predicate; rules of one bit; bits of one word.
SHORTEST, CLAUSES, SLOT, WORD = 3, 6, 8, 62


class Pred(str):
    """SQL of a predicate. ``needs``: of each set at least one text occurs wherever the predicate holds; ``never`` holds nowhere."""

    needs: tuple[frozenset[str], ...] = ()
    never: bool = False


def pred(sql: str, *needs: Iterable[str] | None) -> Pred:
    out = Pred(sql)
    out.needs = tuple(frozenset(n) for n in needs if n)
    return out


def like(sql: str, other: str) -> Pred:
    """``sql`` holds only where ``other`` does."""
    out = Pred(sql)
    out.needs, out.never = getattr(other, "needs", ()), getattr(other, "never", False)
    return out


def never(sql: str = "false") -> Pred:
    out = Pred(sql)
    out.never = True
    return out


def _weight(need: frozenset[str]) -> float:
    """Longer texts in smaller sets are met less often."""
    return min(map(len, need)) / (1 + 0.1 * len(need))


def all_of(preds: Iterable[str], sql: str) -> Pred:
    preds = list(preds)
    out = Pred(sql)
    found = {n for p in preds for n in getattr(p, "needs", ())}
    out.needs = tuple(sorted(found, key=lambda n: (-_weight(n), sorted(n)))[:CLAUSES])
    out.never = any(getattr(p, "never", False) for p in preds)
    return out


def any_of(preds: Iterable[str], sql: str) -> Pred:
    out = Pred(sql)
    live = [p for p in preds if not getattr(p, "never", False)]
    out.never = not live
    if live and all(getattr(p, "needs", ()) for p in live):
        out.needs = (frozenset().union(*[max(p.needs, key=lambda n: (_weight(n), sorted(n))) for p in live]),)
    return out


def _runs(text: str) -> list[str]:
    return [r for r in re.findall(r"[\x04-\x7f]+", text) if len(r) >= SHORTEST]


def longest(parts: Iterable[str]) -> list[str] | None:
    """The longest ASCII text among ``parts`` as a need, None without one."""
    runs = [r for p in parts for r in _runs(p.lower())]
    return [max(runs, key=len)] if runs else None


def anchored(field: str, value: str, head: bool, end: bool) -> list[str] | None:
    """Text of a field (named as its lowered column) that equals, starts or ends with a value."""
    value = value.lower()
    if not re.fullmatch(r"[\x04-\x7f]+", value):
        return longest([value])
    text = (f"{HEAD}{field}{NAMED}" if head else "") + value + (END if end else "")
    return [text] if head or len(text) >= SHORTEST else None


def of_regex(pattern: str) -> list[list[str]]:
    """Texts that every match of a regular expression holds; nothing where the expression is not plainly understood."""
    if "&&" in pattern or "[[" in pattern or "\\Q" in pattern or re.search(r"\(\?[a-z]*x", pattern):
        return []
    try:
        from re import _parser

        tree = _parser.parse(pattern)
    except Exception:  # noqa: BLE001  syntax of the other engine, or another Python
        return []
    found: list[list[str]] = []

    def walk(items) -> None:
        run = ""
        for op, arg in items:
            if str(op) == "LITERAL" and 4 <= arg < 128:
                run += chr(arg).lower()
                continue
            found.extend([r] for r in _runs(run))
            run = ""
            if str(op) == "SUBPATTERN":
                walk(arg[3])
            elif str(op) in ("MAX_REPEAT", "POSSESSIVE_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                walk(arg[2])
            elif str(op) == "ATOMIC_GROUP":
                walk(arg)
        found.extend([r] for r in _runs(run))

    walk(tree)
    return found


def _chosen(preds: dict[int, Pred]) -> dict[int, frozenset[str]]:
    """One need per rule: that whose texts the fewest rules share."""
    shared = Counter(t for p in preds.values() for n in p.needs for t in n)
    return {pos: min(p.needs, key=lambda n: (sum(shared[t] for t in n) / min(map(len, n)), sorted(n))) for pos, p in preds.items() if p.needs}


class LiteralIndex:
    """Automaton over the chosen texts of a rule set.

    ``slots`` are groups of up to ``SLOT`` rules of one log source that share texts where
    possible; ``rest`` are the rules without a text, which are always evaluated.
    """

    def __init__(self, preds: dict[int, Pred], group_of: dict[int, object]):
        chosen = _chosen(preds)
        self.rest = [pos for pos in preds if pos not in chosen]
        by_group = defaultdict(list)
        for pos in chosen:
            by_group[group_of[pos]].append(pos)
        self.slots: list[list[int]] = []
        for members in by_group.values():
            members.sort(key=lambda pos: (sorted(chosen[pos]), pos))
            self.slots += [members[i:i + SLOT] for i in range(0, len(members), SLOT)]
        self.masks: dict[str, int] = defaultdict(int)
        for bit, members in enumerate(self.slots):
            for pos in members:
                for text in chosen[pos]:
                    self.masks[text] |= 1 << bit
        self.words = -(-len(self.slots) // WORD)
        text = "".join(self.masks)
        self.fields = sorted({m for m in re.findall(f"{HEAD}([a-z0-9_]+){NAMED}", text)})
        self.machine = None

    def __getstate__(self):
        return {**self.__dict__, "machine": None}

    def build(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for text, mask in self.masks.items():
            machine.add_word(text, mask)
        machine.make_automaton()
        self.machine = machine

    def met(self, text: str) -> int:
        """Bits of the slots that hold a rule whose text occurs."""
        out = 0
        for _, mask in self.machine.iter(text):
            out |= mask
        return out

    def where(self, slot: int) -> str:
        """SQL that tells whether a slot was met."""
        return f"(met.w{slot // WORD} & {1 << slot % WORD}L) <> 0"

    def attach(self, df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        """Adds ``met``, the slots to be evaluated, out of lowered text columns by name."""
        parts = [F.concat(F.lit(f"{HEAD}{name}{NAMED}"), c, F.lit(END)) for name, c in columns.items()]
        shared = df.sparkSession.sparkContext.broadcast(self)
        words, low = self.words, (1 << WORD) - 1

        @F.pandas_udf("struct<" + ",".join(f"w{i}:bigint" for i in range(words)) + ">")
        def search(texts: pd.Series) -> pd.DataFrame:
            index = shared.value
            if index.machine is None:
                index.build()
            met = [index.met(t) for t in texts]
            return pd.DataFrame({f"w{i}": [m >> (WORD * i) & low for m in met] for i in range(words)})

        return df.withColumn("met", search(F.concat_ws("", *parts)))


def available() -> bool:
    try:
        import ahocorasick  # noqa: F401
    except ImportError:
        return False
    return True
