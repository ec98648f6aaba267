"""Keyed state on streams: scan triggers, alert de-duplication and session addresses.

Rows of a key are handled in (ts, seq) order within a micro-batch by automata whose state is
a fixed number of values, whatever passes through them. The folds only move forward in
time: a row older than the watermark changes no state and comes out marked ``late``, so
that a sink can keep it apart (``sources.start_split``). State is dropped once the watermark
has left it behind.

Spark itself drops late rows in front of an operator with event-time timeouts, by the column
that carries the watermark. The operators therefore get the time of a row as a plain column,
and a column with the watermark's mark that is never late.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from emberwatch.operators.behavior import ALERT_SECONDS, HORIZON_SECONDS, SEQUENCES, SINGLE_CALLS, TRIGGER_SECONDS

NEVER = -(1 << 61)
_FAR = "2200-01-01 00:00:00"


def _keyed(rows: DataFrame, columns: list[str], delay: str) -> DataFrame:
    """``columns`` of a stream under a watermark on ``ts`` that drops no row."""
    rows = rows.select(*columns).withWatermark("ts", delay)
    plain = [F.timestamp_micros(F.unix_micros("ts")).alias("ts") if c == "ts" else F.col(c) for c in columns]
    return rows.select(*plain, F.to_timestamp(F.lit(_FAR)).alias("clock", metadata={"spark.watermarkDelayMs": 0}))


class Calls:
    """Automaton of the call patterns of one process.

    ``seen`` is the last time of every call that can start a pattern, ``paired`` for every
    sequence the last time of its first call that a second call has followed, ``last`` the
    last trigger.
    """

    firsts = list(dict.fromkeys([a for a, _, _ in SEQUENCES] + [c for c, _ in SINGLE_CALLS]))

    def __init__(self, horizon: int, gap: int, state: tuple | None = None):
        self.back, self.pause = horizon * 1_000_000, gap * 1_000_000
        seen, paired, self.last = state or ([NEVER] * len(self.firsts), [NEVER] * len(SEQUENCES), NEVER)
        self.seen, self.paired = dict(zip(self.firsts, seen)), list(paired)

    def state(self) -> tuple:
        return [self.seen[c] for c in self.firsts], self.paired, self.last

    def newest(self) -> int:
        return max(*self.seen.values(), *self.paired, self.last)

    def step(self, us: int, call: str) -> str | None:
        """Reason of a trigger at this call, if it is one."""
        seen, paired = self.seen, self.paired
        for i, (a, b, _) in enumerate(SEQUENCES):
            if call == b and NEVER < seen[a] <= us and seen[a] > paired[i]:
                paired[i] = seen[a]
        if call in seen and us > seen[call]:
            seen[call] = us
        if us - self.last < self.pause:
            return None
        since = us - self.back
        for i, (_, _, name) in enumerate(SEQUENCES):
            if since < paired[i] <= us:
                self.last = us
                return name
        for c, name in SINGLE_CALLS:
            if since < seen[c] <= us:
                self.last = us
                return name
        return None


class Alerts:
    """Automaton of the alerts of one process: time and signature of the last one reported."""

    def __init__(self, seconds: int, state: tuple | None = None):
        self.pause = seconds * 1_000_000
        self.last, self.signature = state or (NEVER, None)

    def state(self) -> tuple:
        return self.last, self.signature

    def newest(self) -> int:
        return self.last

    def step(self, us: int, signature: str | None) -> bool:
        if self.last > NEVER and signature == self.signature and us - self.last < self.pause:
            return False
        self.last, self.signature = us, signature
        return True


class Session:
    """Automaton of one session: the address of its latest login, and when it was last heard of."""

    def __init__(self, state: tuple | None = None):
        self.address, self.heard = state or (None, NEVER)

    def state(self) -> tuple:
        return self.address, self.heard

    def newest(self) -> int:
        return self.heard

    def step(self, us: int, address) -> str | None:
        self.address = address if isinstance(address, str) else self.address
        self.heard = max(self.heard, us)
        return self.address


def _folded(make, keep_ms: int, value: str, columns: list[str], row):
    """A stateful step: ``make(state)`` gives the automaton, ``row(head, late, result)`` an output row or None."""

    def step(key, frames, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        water_ms = state.getCurrentWatermarkMs()
        water = water_ms * 1000
        automaton = make(state.get if state.exists else None)
        pdf = pd.concat(list(frames), ignore_index=True)
        pdf = pdf.assign(us=pdf["ts"].astype("datetime64[us]").astype("int64")).sort_values(["us", "seq"])
        out = []
        for us, seq, ts, v in zip(pdf["us"].tolist(), pdf["seq"].tolist(), pdf["ts"], pdf[value].tolist()):
            late = us < water
            got = row((*key, seq, ts), late, v, None if late else automaton.step(us, v))
            if got is not None:
                out.append(got)
        if automaton.newest() > NEVER:
            state.update(automaton.state())
            state.setTimeoutTimestamp(max(automaton.newest() // 1000 + keep_ms, water_ms + 1))
        yield pd.DataFrame(out, columns=columns)

    return step


def scan_trigger_stream(calls: DataFrame, horizon: int = HORIZON_SECONDS, gap: int = TRIGGER_SECONDS, delay: str = "30 seconds") -> DataFrame:
    """Stream of scan triggers: ``host, pid, seq, ts, syscall, reason, late``. Input: ``seq, ts, host, pid, syscall``.

    Late calls have no reason. Calls that can take part in no pattern are left out.
    """
    wanted = sorted({c for a, b, _ in SEQUENCES for c in (a, b)} | {c for c, _ in SINGLE_CALLS})
    columns = ["host", "pid", "seq", "ts", "syscall", "reason", "late"]
    step = _folded(lambda state: Calls(horizon, gap, state), max(horizon, gap) * 1000, "syscall", columns,
                   lambda head, late, call, why: (*head, call, why, late) if late or why else None)
    src = _keyed(calls.where(F.col("syscall").isin(wanted)), ["seq", "ts", "host", "pid", "syscall"], delay)
    return src.groupBy("host", "pid").applyInPandasWithState(
        step, "host string, pid long, seq long, ts timestamp, syscall string, reason string, late boolean",
        "seen array<long>, paired array<long>, last long", "append", GroupStateTimeout.EventTimeTimeout)


def alert_stream(alerts: DataFrame, seconds: int = ALERT_SECONDS, delay: str = "30 seconds") -> DataFrame:
    """Stream of alerts without repetitions: ``host, pid, seq, ts, signature, late``."""
    columns = ["host", "pid", "seq", "ts", "signature", "late"]
    step = _folded(lambda state: Alerts(seconds, state), seconds * 1000, "signature", columns,
                   lambda head, late, signature, new: (*head, signature, late) if late or new else None)
    src = _keyed(alerts, ["seq", "ts", "host", "pid", "signature"], delay)
    return src.groupBy("host", "pid").applyInPandasWithState(
        step, "host string, pid long, seq long, ts timestamp, signature string, late boolean", "last long, signature string",
        "append", GroupStateTimeout.EventTimeTimeout)


def session_address_stream(events: DataFrame, delay: str = "30 seconds", keep_hours: int = 24) -> DataFrame:
    """Source address of the session's latest login for every event: ``host, session, seq, ts, source_ip, late``.

    Input: ``seq, ts, host, session, address`` where only login rows carry an address. Late
    events have no address: which login was the latest at their time is no longer known.
    """
    columns = ["host", "session", "seq", "ts", "source_ip", "late"]
    step = _folded(Session, keep_hours * 3_600_000, "address", columns, lambda head, late, _, known: (*head, known, late))
    src = _keyed(events, ["seq", "ts", "host", "session", "address"], delay)
    return src.groupBy("host", "session").applyInPandasWithState(
        step, "host string, session string, seq long, ts timestamp, source_ip string, late boolean", "address string, heard long",
        "append", GroupStateTimeout.EventTimeTimeout)
