"""Tokens that live for a while: approvals that are asked for and given, cancellations that may come before
their request. Both have a limit on how many are open, so what an event does depends on all events before it;
the rules are small state machines, and a table or a stream of events is folded through them.

Events have a key (the process that holds the tokens), event_id, ts (timestamp), kind, token, and further
fields of the machine. Each event gets a verdict, and so does each token that expires unused, at that moment.
Events of a key take effect in order of ts and event_id; one with an event_id that was seen is ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Columns of events and of verdicts.
EVENT = ["key", "event_id", "at", "kind", "token", "purpose", "size"]
VERDICT = "key string, at timestamp, event_id long, token string, verdict string"


class Approvals:
    """ask opens a token for a purpose, with the size of what waits for it; answer uses it up. No more than
    `most` are open, of `room` bytes together. Verdicts: open, refused (a limit), repeated (the token is open
    already), used, invalid (never asked for, used, expired or for another purpose), expired."""

    def __init__(self, seconds: int = 300, most: int = 8, room: int = 32 * 1024 * 1024):
        self.life, self.most, self.room = seconds * 1000, most, room

    def expired(self, state: dict, upto: int) -> list[tuple[int, str, str]]:
        gone = sorted((ends, token) for token, (ends, _, _) in state.items() if ends <= upto)
        for _, token in gone:
            del state[token]
        return [(ends, token, "expired") for ends, token in gone]

    def step(self, state: dict, e: dict) -> str:
        token, purpose = e["token"] or "", e["purpose"] or ""
        if e["kind"] == "ask":
            if token in state:
                return "repeated"
            size = int(e["size"] or 0)
            if len(state) >= self.most or size + sum(s for _, _, s in state.values()) > self.room:
                return "refused"
            state[token] = [e["at"] + self.life, purpose, size]
            return "open"
        if not 1 <= len(token) <= 128 or token not in state or state[token][1] != purpose:
            return "invalid"
        del state[token]
        return "used"

    def next_end(self, state: dict) -> int | None:
        return min((ends for ends, _, _ in state.values()), default=None)


class Cancellations:
    """start makes a token active, finish ends it, cancel stops an active one or waits for a start that has
    not come yet; no more than `most` wait. Verdicts: started, cancelled (a cancel was waiting), already active,
    stopped, waiting, refused (the limit), finished, bad token, expired (a cancel waited in vain)."""

    FORM = re.compile(r"[a-f0-9-]{32,64}")

    def __init__(self, seconds: int = 30, most: int = 32):
        self.life, self.most = seconds * 1000, most

    def expired(self, state: dict, upto: int) -> list[tuple[int, str, str]]:
        waiting = state.setdefault("waiting", {})
        gone = sorted((ends, token) for token, ends in waiting.items() if ends <= upto)
        for _, token in gone:
            del waiting[token]
        return [(ends, token, "expired") for ends, token in gone]

    def step(self, state: dict, e: dict) -> str:
        waiting, active, token = state.setdefault("waiting", {}), state.setdefault("active", []), e["token"] or ""
        if not self.FORM.fullmatch(token):
            return "bad token"
        if e["kind"] == "start":
            if token in active:
                return "already active"
            active.append(token)
            return "started" if waiting.pop(token, None) is None else "cancelled"
        if e["kind"] == "finish":
            waiting.pop(token, None)
            if token in active:
                active.remove(token)
            return "finished"
        if token in active:
            return "stopped"
        if token not in waiting and len(waiting) >= self.most:
            return "refused"
        waiting[token] = e["at"] + self.life
        return "waiting"

    def next_end(self, state: dict) -> int | None:
        return min(state.get("waiting", {}).values(), default=None)


def advance(machine, state: dict, events: list[dict], upto: int | None) -> list[tuple[int, int | None, str, str]]:
    """Verdicts (at, event_id, token, verdict) of events in order, with what expires between them and, if upto is
    given, until then. state is changed."""
    out = []
    for e in events:
        out += [(at, None, token, verdict) for at, token, verdict in machine.expired(state, e["at"])]
        out.append((e["at"], e["event_id"], e["token"], machine.step(state, e)))
    if upto is not None:
        out += [(at, None, token, verdict) for at, token, verdict in machine.expired(state, upto)]
    return out


def _frame(key: str, found: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=["at", "event_id", "token", "verdict"])
    return pd.DataFrame({"key": key, "at": pd.to_datetime(out["at"].astype("int64"), unit="ms"), "event_id": out["event_id"].astype("Int64"), "token": out["token"], "verdict": out["verdict"]})


def _events(df: DataFrame) -> DataFrame:
    """The columns of EVENT; times in milliseconds, missing fields null. Rows without key or time go."""
    has = {c.lower() for c in df.columns}
    one = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind).alias(c)
    at = F.unix_millis(F.col("ts").cast("timestamp")).alias("at")
    return df.where("key is not null and ts is not null").select(
        F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), at, one("kind", "string"), one("token", "string"), one("purpose", "string"), one("size", "long"))


def settled(events: DataFrame, machine, upto: str | None = None) -> DataFrame:
    """key, at, event_id (null for an expiry), token, verdict for a table of events; with upto (a time), what has
    expired by then as well. A key's events are read in order, one after the other, and only what is open is kept."""
    end = None if upto is None else int(pd.Timestamp(upto).value // 1_000_000)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, last = None, {}, None
        for batch in batches:
            for own, rows in batch.groupby("key", sort=False):
                if own != key:
                    if key is not None and end is not None:
                        yield _frame(key, advance(machine, state, [], end))
                    key, state, last = own, {}, None
                found = []
                for e in rows.astype(object).where(rows.notna(), None).to_dict("records"):
                    if (e["at"], e["event_id"]) != last or e["event_id"] is None:
                        found.append(e | {"at": int(e["at"])})
                    last = (e["at"], e["event_id"])
                yield _frame(key, advance(machine, state, found, None))
        if key is not None and end is not None:
            yield _frame(key, advance(machine, state, [], end))

    ordered = _events(events).repartition("key").sortWithinPartitions("key", "at", "event_id")
    return ordered.mapInPandas(each, VERDICT)


class Folding(StatefulProcessor):
    """Holds a key's events until the watermark has passed them, so that they take effect in order of time
    however they arrive, and wakes up when the next one is due or the next open token ends."""

    def __init__(self, machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "open string")
        self.held = handle.getListState("held", "event_id long, at long, kind string, token string, purpose string, size long")

    def _read(self) -> tuple[dict, list[dict]]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        held = [dict(zip(EVENT[1:], row, strict=True)) for row in self.held.get()] if self.held.exists() else []
        return state, held

    def _due(self, key, state: dict, held: list[dict], now: int) -> pd.DataFrame:
        ready = sorted((e for e in held if e["at"] <= now), key=lambda e: (e["at"], e["event_id"] is None, e["event_id"] or 0))
        found = advance(self.machine, state, ready, now)
        held = [e for e in held if e["at"] > now]
        self.state.update((json.dumps(state),))
        if held:
            self.held.put([tuple(e[c] for c in EVENT[1:]) for e in held])
        else:
            self.held.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        following = min([e["at"] for e in held] + [x for x in [self.machine.next_end(state)] if x is not None], default=None)
        if following is not None:
            self.handle.registerTimer(max(following, now + 1))
        return _frame(key[0], found)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, held = self._read()
        known = {e["event_id"] for e in held}
        for batch in rows:
            for e in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                if e["event_id"] is None or e["event_id"] not in known:
                    known.add(e["event_id"])
                    held.append({c: e[c] for c in EVENT[1:]} | {"at": int(e["at"])})
        yield self._due(key, state, held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, held = self._read()
        yield self._due(key, state, held, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream(events: DataFrame, machine, late: str = "1 minute") -> DataFrame:
    """The same for a stream of events, as far as its watermark has come: events that arrive up to `late`
    behind the newest one count at their time, later ones go. State lives in the query's checkpoint; a restart goes
    on from there. The session's state store must be RocksDB's (spark.sql.streaming.stateStore.providerClass)."""
    watched = _events(events).withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", late)
    return watched.groupBy("key").transformWithStateInPandas(Folding(machine), VERDICT, "Append", "EventTime")
