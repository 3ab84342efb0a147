"""Conversation memory as a stream: bounded state per session, in the order of turns however they arrive."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from quern.operators.sessions import CHARS, TURNS

OUT = "session string, turn_count bigint, character_count bigint, first_turn bigint, last_turn bigint"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def remember(turns: list[int], chars: list[int], max_turns: int = TURNS, max_chars: int = CHARS) -> tuple[list[int], list[int]]:
    """Drop the oldest turns until both budgets hold; the newest stays."""
    turns, chars = turns[-max_turns:], chars[-max_turns:]
    while len(turns) > 1 and sum(chars) > max_chars:
        turns, chars = turns[1:], chars[1:]
    return turns, chars


def placed(kept: list[tuple[int, int]], floor: int | None, turn: int, chars: int, max_turns: int = TURNS, max_chars: int = CHARS) -> tuple[list[tuple[int, int]], int | None]:
    """What is kept, and the newest turn ever dropped, after one more turn, which may be a late one.

    What was dropped never comes back, since more turns only leave less room for it; and whatever is older than it goes too.
    """
    if floor is not None and turn <= floor:
        return kept, floor
    held = [*kept]
    insort(held, (turn, chars))
    left, _ = remember([t for t, _ in held], [c for _, c in held], max_turns, max_chars)
    gone = len(held) - len(left)
    return held[gone:], held[gone - 1][0] if gone else floor


class Memory(StatefulProcessor):
    """State of a session: the turns that are kept, the newest that was dropped, and when it was last spoken to."""

    def __init__(self, max_turns: int, max_chars: int, idle_ms: int | None):
        self.max_turns, self.max_chars, self.idle_ms = max_turns, max_chars, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn bigint, chars bigint")
        self.floor = handle.getValueState("floor", "turn bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        kept = [(int(t), int(c)) for t, c in self.turns.get()] if self.turns.exists() else []
        floor = int(self.floor.get()[0]) if self.floor.exists() else None
        for frame in rows:
            for t, c in frame[["turn", "chars"]].itertuples(index=False):
                kept, floor = placed(kept, floor, int(t), int(c), self.max_turns, self.max_chars)
        self.turns.put(kept)
        if floor is not None:
            self.floor.update((floor,))
        if self.idle_ms is not None:
            if self.timer.exists():
                self.handle.deleteTimer(int(self.timer.get()[0]))
            at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(at)
            self.timer.update((at,))
        yield pd.DataFrame([(key[0], len(kept), sum(c for _, c in kept), kept[0][0], kept[-1][0])], columns=["session", "turn_count", "character_count", "first_turn", "last_turn"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.turns, self.floor, self.timer):
            state.clear()
        yield pd.DataFrame({"session": [key[0]], "turn_count": [0], "character_count": [0], "first_turn": pd.array([None], "Int64"), "last_turn": pd.array([None], "Int64")})

    def close(self) -> None:
        pass


def streaming_memory(turns: DataFrame, max_turns: int = TURNS, max_chars: int = CHARS, idle_ms: int | None = None) -> DataFrame:
    """One row a session and batch: what is remembered, the same as ``sessions.remembered`` keeps of all turns so far, in whatever order they
    came. turns: session, turn (its own number in the session), chars; a stream. After ``idle_ms`` without a turn a session is forgotten and
    told with no turns. The session's state store becomes RocksDB, which this kind of state needs."""
    turns.sparkSession.conf.set(STORE, ROCKS)
    memory = Memory(max_turns, max_chars, idle_ms)
    return turns.groupBy("session").transformWithStateInPandas(memory, OUT, "Update", "ProcessingTime" if idle_ms is not None else "None")


def pending_stream(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """New rows of a file stream that a static table of finished keys doesn't hold."""
    return work.join(done.select(key).distinct(), key, "left_anti")
