"""Circuit state per dependency, from a log of calls.

A call row has circuit, ts, call_id, ok and ignored (an error that does not count). Calls
run in the order of (ts, call_id); event time takes the place of a clock.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"
STATES = "circuit string, ts timestamp, call_id long, admitted boolean, state string"
_EXIT = "struct<state:string,failures:int,opened:long>"
_SUMMARY = f"circuit string, block long, closed array<{_EXIT}>, resume_from array<long>, resumed array<{_EXIT}>"


@dataclass(frozen=True)
class BreakerRules:
    failures: int = 5
    recovery_seconds: float = 30.0
    probes: int = 1

    @property
    def recovery_us(self) -> int:
        return int(self.recovery_seconds * 1_000_000)


def advance(state: tuple, now: int, ok: bool, ignored: bool, rules: BreakerRules) -> tuple[tuple, bool]:
    """State (name, failures while closed, opened at) after one call, and whether it ran."""
    name, failures, opened = state
    if name == OPEN:
        if now - opened < rules.recovery_us:
            return state, False
        name, failures, opened = HALF_OPEN, 0, 0
    if name == HALF_OPEN and rules.probes < 1:
        return (HALF_OPEN, 0, 0), False
    if ok:
        return (CLOSED, 0, 0), True
    if ignored:
        return (name, failures, opened), True
    if name == HALF_OPEN or failures + 1 >= rules.failures:
        return (OPEN, 0, now), True
    return (CLOSED, failures + 1, 0), True


START = (CLOSED, 0, 0)


def _exits(calls: list[tuple], rules: BreakerRules) -> tuple[list[tuple], list[int], list[tuple]]:
    """Exit state of a block for every entry state.

    Runs that reach the same state at the same call share the rest, so the work stays close
    to one pass. An open circuit resumes at the first call past its recovery time; only
    calls within one recovery time of the start, and the next one, can be that call.
    """
    known: dict[tuple, tuple] = {}

    def run(at: int, state: tuple) -> tuple:
        seen = []
        while at < len(calls) and (at, state) not in known:
            seen.append((at, state))
            now, ok, ignored = calls[at]
            state, _ = advance(state, now, ok, ignored, rules)
            at += 1
        result = known.get((at, state), state)
        known.update(dict.fromkeys(seen, result))
        return result

    closed = [run(0, (CLOSED, f, 0)) for f in range(rules.failures)]
    times, resumed = [], []
    for at, (now, _, _) in enumerate(calls):
        times.append(now)
        resumed.append(run(at, (HALF_OPEN, 0, 0)))
        if now - calls[0][0] >= rules.recovery_us:
            break
    return closed, times, resumed


def _rows(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    for pdf in batches:
        yield from zip(*(pdf[c].tolist() for c in columns))


def _frames(rows: Iterator[tuple], columns: list[str], size: int = 20_000) -> Iterator[pd.DataFrame]:
    while block := list(islice(rows, size)):
        yield pd.DataFrame(block, columns=columns)


def breaker_states(calls: DataFrame, failures: int = 5, recovery_seconds: float = 30.0, probes: int = 1,
                   block_seconds: int = 86_400) -> DataFrame:
    """State after every call, for call logs of any size and skew.

    A circuit's log is cut into time blocks that are summarised in parallel as a map from
    entry state to exit state. Chaining those short summaries gives every block its entry
    state, and the blocks are replayed in parallel. One busy circuit thus spreads over as
    many tasks as it has blocks; a task holds one block at a time.
    """
    rules = BreakerRules(failures, recovery_seconds, probes)
    log = calls.select(
        F.col("circuit").cast("string").alias("circuit"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("call_id").cast("long").alias("call_id"), "ok", F.coalesce("ignored", F.lit(False)).alias("ignored"),
    ).withColumn("block", F.floor(F.col("us") / (1_000_000 * block_seconds)).cast("long"))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def blocks():
            rows = _rows(batches, ["circuit", "block", "us", "ok", "ignored"])
            for (circuit, block), group in groupby(rows, key=lambda r: r[:2]):
                closed, times, resumed = _exits([r[2:] for r in group], rules)
                yield circuit, block, [_as_struct(x) for x in closed], times, [_as_struct(x) for x in resumed]

        yield from _frames(blocks(), ["circuit", "block", "closed", "resume_from", "resumed"], 500)

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def entries():
            rows = _rows(batches, ["circuit", "block", "closed", "resume_from", "resumed"])
            for circuit, group in groupby(rows, key=lambda r: r[0]):
                state = START
                for _, block, *summary in group:
                    yield circuit, block, *state
                    state = _through(state, *summary, rules)

        yield from _frames(entries(), ["circuit", "block", "entry_state", "entry_failures", "entry_opened"])

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def states():
            columns = ["circuit", "block", "ts", "us", "call_id", "ok", "ignored", "entry_state", "entry_failures", "entry_opened"]
            for (circuit, _), group in groupby(_rows(batches, columns), key=lambda r: r[:2]):
                state = None
                for _, _, ts, us, call_id, ok, ignored, *entry in group:
                    state, ran = advance(state or tuple(entry), us, ok, ignored, rules)
                    yield circuit, ts, call_id, ran, state[0]

        yield from _frames(states(), ["circuit", "ts", "call_id", "admitted", "state"])

    keys = ["circuit", "block"]
    summaries = (
        log.select(*keys, "us", "call_id", "ok", "ignored").repartition(*keys).sortWithinPartitions(*keys, "us", "call_id")
        .mapInPandas(summarise, _SUMMARY)
    )
    entries = summaries.repartition("circuit").sortWithinPartitions(*keys).mapInPandas(
        chain, "circuit string, block long, entry_state string, entry_failures int, entry_opened long"
    )
    return (
        log.join(entries, keys).repartition(*keys).sortWithinPartitions(*keys, "us", "call_id").mapInPandas(replay, STATES)
    )


def _as_struct(state: tuple) -> dict:
    return {"state": state[0], "failures": state[1], "opened": state[2]}


def _through(state: tuple, closed, resume_from, resumed, rules: BreakerRules) -> tuple:
    """Take an entry state through a summarised block."""
    def unpack(s) -> tuple:
        return s["state"], int(s["failures"]), int(s["opened"])

    if state[0] == CLOSED:
        return unpack(closed[state[1]])
    ready = state[2] + rules.recovery_us if state[0] == OPEN else None
    for start, result in zip(resume_from, resumed):
        if ready is None or start >= ready:
            return unpack(result)
    return state


#: A waiting call; circuit is its place in the names kept beside the calls.
_CALL = np.dtype([("circuit", "<i4"), ("us", "<i8"), ("call_id", "<i8"), ("ok", "?"), ("ignored", "?")])


class BreakerProcessor(StatefulProcessor):
    """Streaming form: calls wait until the watermark passes them, then run in order.

    A key is a slot, the circuits of one hash value. Waiting calls are kept as one block per data frame of input, and only
    circuits that differ from the start have a state, so reads, writes and timers go by slot, not by call or circuit.
    """

    def __init__(self, rules: BreakerRules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getValueState("states", "circuit array<string>, name array<string>, failures array<int>, opened array<long>")
        self.waiting = handle.getListState("waiting", "names array<string>, calls binary")
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for pdf in rows:
            calls = np.empty(len(pdf), _CALL)
            calls["circuit"], names = _numbered(pdf["circuit"])
            for column in ("us", "call_id"):
                calls[column] = pdf[column].astype("int64")
            for column in ("ok", "ignored"):
                calls[column] = pdf[column].astype("bool")
            self.waiting.appendValue((names, calls.tobytes()))
            first.append(int(calls["us"].min()))
        self._wake_at(min(first) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        calls, names = self._waiting()
        due, later = calls[calls["us"] < limit], calls[calls["us"] >= limit]
        if len(later):
            places, used = np.unique(later["circuit"], return_inverse=True)
            later["circuit"] = used
            self.waiting.put([([names[i] for i in places.tolist()], later.tobytes())])
            self._wake_at(int(later["us"].min()) // 1000 + 1)
        else:
            self.waiting.clear()
        if len(due):
            yield from self._run(due, names)

    def _waiting(self) -> tuple[np.ndarray, list]:
        """All waiting calls of the slot, and the names of their circuits."""
        places, blocks = {}, []
        for names, packed in self.waiting.get():
            block = np.frombuffer(packed, _CALL).copy()
            block["circuit"] = np.array([places.setdefault(n, len(places)) for n in names], "int32")[block["circuit"]]
            blocks.append(block)
        return np.concatenate(blocks), list(places)

    def _run(self, due: np.ndarray, names: list, size: int = 50_000) -> Iterator[pd.DataFrame]:
        """Run calls in the order of their circuits, some at a time; states that differ from the start are kept."""
        due = due[np.lexsort([due[c] for c in ("ignored", "ok", "call_id", "us", "circuit")])]
        kept = self.states.get()
        states = {circuit: state for circuit, *state in zip(*kept)} if kept else {}
        for part in (due[at:at + size] for at in range(0, len(due), size)):
            admitted, after = [], []
            for place, group in groupby(zip(*(part[c].tolist() for c in ("circuit", "us", "ok", "ignored"))), key=itemgetter(0)):
                state = tuple(states.pop(names[place], START))
                for _, us, ok, ignored in group:
                    state, ran = advance(state, us, ok, ignored, self.rules)
                    admitted.append(ran)
                    after.append(state[0])
                if state != START:
                    states[names[place]] = state
            yield pd.DataFrame({
                "circuit": np.array(names, dtype="object")[part["circuit"]], "ts": pd.to_datetime(part["us"], unit="us", utc=True),
                "call_id": part["call_id"], "admitted": np.array(admitted, dtype="bool"), "state": np.array(after, dtype="object"),
            })
        if states:
            self.states.update(([*states], *map(list, zip(*states.values()))))
        elif kept:
            self.states.clear()

    def _wake_at(self, ms: int) -> None:
        """One timer per slot, at its earliest waiting call."""
        if current := self.timer.get():
            if current[0] <= ms:
                return
            self.handle.deleteTimer(current[0])
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def close(self) -> None:
        pass


def _numbered(circuits: pd.Series) -> tuple[np.ndarray, list]:
    """Place of every circuit in the list of names that follows; null is a name too."""
    places, names = pd.factorize(circuits, use_na_sentinel=False)
    return places, [None if pd.isna(n) else n for n in names]


def breaker_stream(calls: DataFrame, failures: int = 5, recovery_seconds: float = 30.0, probes: int = 1,
                   watermark: str = "10 minutes", slots: int = 4096) -> DataFrame:
    """Streaming states. Needs the RocksDB state store provider.

    Circuits share ``slots`` keys by their hash, since every key costs calls between the JVM and Python; a checkpoint goes
    with its number of slots. A slot's calls that wait are sorted in one task.
    """
    log = calls.withWatermark("ts", watermark).select(
        F.col("circuit").cast("string").alias("circuit"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("call_id").cast("long").alias("call_id"), F.coalesce("ok", F.lit(False)).alias("ok"),
        F.coalesce("ignored", F.lit(False)).alias("ignored"),
    ).withColumn("slot", F.pmod(F.xxhash64("circuit"), F.lit(slots)))
    return log.groupBy("slot").transformWithStateInPandas(
        BreakerProcessor(BreakerRules(failures, recovery_seconds, probes)),
        T._parse_datatype_string(STATES), "append", "EventTime",
    )
