"""Guards of running agents as keyed state of a stream.

Each guard is an operator of Structured Streaming (``transformWithState``): rows come with a key and an order
within it, and an answer goes out for each row. What a key remembers are entries of a map, each written and read by itself and
forgotten ``ttl`` after its last change, so a batch costs what its own rows touch, however much the key has seen. Within one batch rows are taken in the order of
``seq``; across batches in the order of arrival. On a table the same steps run over each key's rows in
order, holding one key's state at a time; ``operators.sequences`` has the same rules as window functions.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenvault.operators.sequences import LOOP_STOP, LOOP_WARN, LOOP_WINDOW

TTL = "1 hour"
#: Fixed value: the state store that entries of maps need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Entries:
    """A map of the state store in the form of a dictionary from one value to a tuple."""

    def __init__(self, state):
        self._state = state

    def __contains__(self, key) -> bool:
        return self._state.containsKey((key,))

    def get(self, key) -> tuple | None:
        return tuple(self._state.getValue((key,))) if key in self else None

    def __setitem__(self, key, value: tuple) -> None:
        self._state.updateValue((key,), value)

    def __delitem__(self, key) -> None:
        self._state.removeKey((key,))


#: Takes a key's rows in their order, its maps and its one value (None at first); gives answers and the new value.
Step = Callable[[pd.DataFrame, dict, tuple | None], tuple[list[tuple], tuple]]


class _Guard(NamedTuple):
    """What a guard is: its step, the columns of its answers, and the schemas of its value and of its maps (key, value)."""

    step: Step
    answer: str
    value: str
    maps: dict[str, tuple[str, str]] = {}


def _milliseconds(ttl: str) -> int:
    return int(pd.Timedelta(ttl).total_seconds() * 1000)


def _framed(guard: _Guard, key: object, answers: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(key, *a) for a in answers], columns=[f.split()[0] for f in guard.answer.split(", ")])


class _Processor(StatefulProcessor):
    def __init__(self, guard: _Guard, ttl: str):
        self._guard, self._ttl = guard, _milliseconds(ttl)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._maps = {name: _Entries(handle.getMapState(name, key, value, ttlDurationMs=self._ttl)) for name, (key, value) in self._guard.maps.items()}
        self._value = handle.getValueState("value", self._guard.value, ttlDurationMs=self._ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self._value.get()) if self._value.exists() else None
        answers, new = self._guard.step(pd.concat(list(rows)).sort_values("seq", kind="stable"), self._maps, held)
        self._value.update(new)
        yield _framed(self._guard, key[0], answers)

    def close(self) -> None:
        pass


def use_map_state(spark: SparkSession) -> None:
    """Make RocksDB the session's state store, as entries of maps need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _kept(rows: DataFrame, key: str, guard: _Guard, mode: str, ttl: str) -> DataFrame:
    """The answers of a guard for each key, behind it. In append mode they are of single rows, in update mode of the key as it stands then."""
    if rows.isStreaming:
        use_map_state(rows.sparkSession)
        return rows.groupBy(key).transformWithStateInPandas(_Processor(guard, ttl), guard.answer, mode.capitalize(), "ProcessingTime")

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come key by key in their order, so the state of one key is all that is held.
        current, held, maps, last = None, None, {}, []
        for frame in frames:
            for value, part in frame.groupby(key, sort=False, dropna=False):
                if (value != current and (value == value or current == current)) or not maps:
                    if last and mode == "update":
                        yield _framed(guard, current, last)
                    current, held, maps = value, None, {"": {}} | {name: {} for name in guard.maps}
                last, held = guard.step(part, maps, held)
                if mode == "append":
                    yield _framed(guard, value, last)
        if last and mode == "update":
            yield _framed(guard, current, last)

    return rows.repartition(key).sortWithinPartitions(key, "seq").mapInPandas(replay, guard.answer)


def loop_guard(calls: DataFrame, window: int = LOOP_WINDOW, warn: int = LOOP_WARN, stop: int = LOOP_STOP, ttl: str = TTL) -> DataFrame:
    """ST1: (thread, seq, times, action) of rows (thread, seq, hash): warn once for a hash, stop each time.

    The state is the last ``window`` hashes and an entry for each hash that was warned of.
    """

    def step(rows: pd.DataFrame, maps: dict, value: tuple | None) -> tuple[list[tuple], tuple]:
        last, warned, out = deque(value[0] if value else ()), maps["warned"], []
        for row in rows.itertuples(index=False):
            last.append(row.hash)
            if len(last) > window:
                last.popleft()
            times, first = sum(h == row.hash for h in last), False
            if times >= warn:
                first = row.hash not in warned
                warned[row.hash] = (True,)
            out.append((row.seq, times, "stop" if times >= stop else "warn" if first else "go"))
        return out, (list(last),)

    return _kept(calls, "thread", _Guard(step, "thread long, seq long, times int, action string", "last array<string>", {"warned": ("hash string", "told boolean")}), "append", ttl)


def turn_guard(turns: DataFrame, most: int = 50, ttl: str = TTL) -> DataFrame:
    """ST2: (thread, seq, turn, action) of rows (thread, seq): warn on the last turn but one, stop from the last on."""

    def step(rows: pd.DataFrame, maps: dict, value: tuple | None) -> tuple[list[tuple], tuple]:
        turn, out = (value[0] if value else 0), []
        for row in rows.itertuples(index=False):
            turn += 1
            out.append((row.seq, turn, "stop" if turn >= most else "warn" if turn == most - 1 else "go"))
        return out, (turn,)

    return _kept(turns, "thread", _Guard(step, "thread long, seq long, turn long, action string", "turn long"), "append", ttl)


def token_guard(usage: DataFrame, limit: int = 1_000_000, warn: float = 0.7, ttl: str = TTL) -> DataFrame:
    """ST3: (run, seq, total, action) of rows (run, seq, message, tokens): a message told again counts only above its own highest count.

    The state is the sum and an entry for each message, as many as there are.
    """

    def step(rows: pd.DataFrame, maps: dict, value: tuple | None) -> tuple[list[tuple], tuple]:
        high, total, out = maps["high"], (value[0] if value else 0), []
        for row in rows.itertuples(index=False):
            known = high.get(row.message)
            before = known[0] if known else 0
            total += max(0, int(row.tokens) - before)
            high[row.message] = (max(int(row.tokens), before),)
            out.append((row.seq, total, "stop" if total >= limit else "warn" if total >= warn * limit else "go"))
        return out, (total,)

    return _kept(usage, "run", _Guard(step, "run long, seq long, total long, action string", "total long", {"high": ("message string", "tokens long")}), "append", ttl)


def ledger(entries: DataFrame, terminal: tuple[str, ...] = ("done", "failed", "cancelled"), most: int = 50, ttl: str = TTL) -> DataFrame:
    """ST5, P20: (run, id, status, created_at, place) of rows (run, seq, id, status, at) after each batch: a terminal status
    stays, created_at is the first one's, and the ``most`` ids first seen last are kept.

    The state is an entry for each kept id, one for each place in their order, and one for each id that was trimmed, as such an id does not come back as a new one.
    """

    def step(rows: pd.DataFrame, maps: dict, value: tuple | None) -> tuple[list[tuple], tuple]:
        known, places, gone = maps["known"], maps["places"], maps["gone"]
        first, end = value or (0, 0)
        for row in rows.itertuples(index=False):
            if row.id in gone:
                continue
            held = known.get(row.id)
            if held is None:
                known[row.id], places[end], end = (row.status, int(row.at)), (row.id,), end + 1
            elif row.status in terminal or held[0] not in terminal:
                known[row.id] = (row.status, held[1])
            if end - first > most:
                old = places.get(first)[0]
                gone[old] = (True,)
                del known[old], places[first]
                first += 1
        ids = [places.get(k)[0] for k in range(first, end)]
        return [(i, *known.get(i), k + 1) for k, i in enumerate(ids)], (first, end)

    maps = {"known": ("id string", "status string, created long"), "places": ("place long", "id string"), "gone": ("id string", "told boolean")}
    return _kept(entries, "run", _Guard(step, "run long, id string, status string, created_at long, place int", "first long, end long", maps), "update", ttl)


def bounded_latest(rows: DataFrame, most: int = 100, ttl: str = TTL) -> DataFrame:
    """ST4: (space, key, value, place) of rows (space, seq, key, value) after each batch: at most ``most`` keys of a space with their last values.

    The key that was put in first goes first; a new value for a key that is there does not make it newer. The state is an entry for each key and one for each place.
    """

    def step(part: pd.DataFrame, maps: dict, value: tuple | None) -> tuple[list[tuple], tuple]:
        held, places = maps["held"], maps["places"]
        first, end = value or (0, 0)
        for row in part.itertuples(index=False):
            if row.key not in held:
                places[end], end = (row.key,), end + 1
            held[row.key] = (row.value,)
            if end - first > most:
                del held[places.get(first)[0]], places[first]
                first += 1
        keys = [places.get(k)[0] for k in range(first, end)]
        return [(k, held.get(k)[0], n + 1) for n, k in enumerate(keys)], (first, end)

    maps = {"held": ("key string", "value string"), "places": ("place long", "key string")}
    return _kept(rows, "space", _Guard(step, "space long, key string, value string, place int", "first long, end long", maps), "update", ttl)


def decode_events(lines: DataFrame) -> DataFrame:
    """(type, message, text, tokens) of a stream of JSON lines (value); lines that are no JSON objects are left out."""
    schema = "type string, part struct<messageID: string, text: string, tokens: struct<input: long, output: long>>"
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e")).where(F.col("e.type").isNotNull())
    return parsed.select(F.col("e.type").alias("type"), F.col("e.part.messageID").alias("message"), F.col("e.part.text").alias("text"), F.col("e.part.tokens").alias("tokens"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n) of a stream of events (ts, event_type) with a watermark. An extension for event time."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")
