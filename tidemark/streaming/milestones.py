"""Milestones of tokens as a stateful stream operator: values, maps, lists and timers per token (STR4, STR5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.state import MILESTONES

OUTPUT = "token string, age bigint, buys bigint, sells bigint, unique_traders bigint, due bigint"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Kinds of events in the operator; other sides count for their trader only.
TICK, BUY, SELL, LAUNCH, OTHER = range(5)
#: Trades in one element of a list state.
PIECE = 1 << 16


def _arrays(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, traders and kinds of trades, put together."""
    return tuple(np.concatenate([np.zeros(0, kind), *part]) for kind, part in zip((np.int64, np.int64, np.int8), zip(*found) if found else ((), (), ())))


class Milestones(StatefulProcessor):
    """Counts of a token up to each milestone.

    A trade belongs to the first milestone at or after it, in whatever order events come.  A batch appends to the
    token's log, in one call, a row a milestone: its trades and its different traders, packed.  At a milestone's
    timer the log is read, a trader counts once, from the first milestone that has them, and the log is packed anew.
    So the calls to the state follow batches and milestones, not traders.
    Trades that come before their launch wait in a list that is only appended to.
    """

    def __init__(self, ages: tuple[int, ...], evict_ms: int):
        self.ages = sorted(ages)
        self.evict_ms = max(evict_ms, self.ages[-1])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: launch, first event, milestones that are done
        self.clock = handle.getValueState("clock", "born bigint, first bigint, done int")
        self.log = handle.getListState("log", "step int, buys bigint, sells bigint, traders binary")
        self.waiting = handle.getListState("waiting", "t binary, trader binary, kind binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = []
        for b in rows:
            t, trader, kind = b["ms"].to_numpy(np.int64), b["trader"].to_numpy(np.int64), b["kind"].to_numpy(np.int8)
            real = kind != TICK
            found.append((t[real], trader[real], kind[real]))
        t, trader, kind = _arrays(found)
        if not len(t):
            return
        born, first, done = self.clock.get() if self.clock.exists() else (None, None, 0)
        if first is None:
            first = int(t.min())
            self.handle.registerTimer(first + self.evict_ms + 1)
        launch, trade = kind == LAUNCH, kind != LAUNCH
        trades = t[trade], trader[trade], kind[trade]
        if born is None and launch.any():
            born = int(t[launch].min())
            self.handle.registerTimer(born + self.ages[0] + 1)
            if self.waiting.exists():
                before = [tuple(np.frombuffer(x, kind) for x, kind in zip(piece, (np.int64, np.int64, np.int8))) for piece in self.waiting.get()]
                trades = _arrays([trades, *before])
                self.waiting.clear()
        if len(trades[0]) and born is None:
            self.waiting.appendList([tuple(x[k : k + PIECE].tobytes() for x in trades) for k in range(0, len(trades[0]), PIECE)])
        elif len(trades[0]) and done < len(self.ages):
            self._add(*trades, born, done)
        self.clock.update((born, first, done))
        yield from ()

    def _add(self, t: np.ndarray, trader: np.ndarray, kind: np.ndarray, born: int, done: int) -> None:
        step = np.maximum(np.searchsorted(np.array(self.ages) + born, t), done)
        more = []
        for s in np.unique(step[step < len(self.ages)]).tolist():
            at = step == s
            more += self._pieces(s, int((kind[at] == BUY).sum()), int((kind[at] == SELL).sum()), np.unique(trader[at]))
        if more:
            self.log.appendList(more)

    def _pieces(self, step: int, buys: int, sells: int, traders: np.ndarray) -> list[tuple]:
        first, *rest = [traders[k : k + PIECE].tobytes() for k in range(0, max(1, len(traders)), PIECE)]
        return [(step, buys, sells, first), *((step, 0, 0, x) for x in rest)]

    def _logged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buys and sells by step, and each trader of the log with their first step."""
        sums, traders, steps = np.zeros((2, len(self.ages)), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step, buys, sells, packed in self.log.get() if self.log.exists() else ():
            sums[:, step] += buys, sells
            traders.append(np.frombuffer(packed, np.int64))
            steps.append(np.full(len(traders[-1]), step))
        trader, step = np.concatenate(traders), np.concatenate(steps)
        order = np.lexsort((step, trader))
        trader, step = trader[order], step[order]
        new = np.append(True, trader[1:] != trader[:-1])[: len(trader)]
        return *sums, trader[new], step[new]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.clock.exists():
            return
        born, first, done = self.clock.get()
        # a timer set here fires with the next batch only, so all milestones that are due by now come at once
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) - 1
        out = []
        if born is not None and done < len(self.ages) and born + self.ages[done] <= now:
            buys, sells, trader, step = self._logged()
            totals = np.cumsum([buys, sells, np.bincount(step, minlength=len(self.ages))], axis=1).T.tolist()
            while done < len(self.ages) and born + self.ages[done] <= now:
                out.append((key[0], self.ages[done], *totals[done], born + self.ages[done]))
                done += 1
            self.clock.update((born, first, done))
            if done < len(self.ages):
                step = np.maximum(step, done - 1)  # what is done is one step of the log
                buys[done - 1], sells[done - 1] = totals[done - 1][:2]
                self.log.put([x for s in range(done - 1, len(self.ages)) for x in self._pieces(s, int(buys[s]), int(sells[s]), trader[step == s])])
                self.handle.registerTimer(born + self.ages[done] + 1)
            else:  # only the mark stays
                self.log.clear()
        end = (first if born is None else born) + self.evict_ms
        if now >= end:
            for state in (self.clock, self.log, self.waiting):
                state.clear()
        elif now >= first + self.evict_ms:  # launched later than its first event
            self.handle.registerTimer(end + 1)
        if out:
            yield pd.DataFrame(out, columns=["token", "age", "buys", "sells", "unique_traders", "due"])


def milestones(events: DataFrame, ages=MILESTONES, evict_ms: int = 7_200_000, time: str = "ts", delay: str = "0 seconds", due: bool = False) -> DataFrame:
    """(token, age, buys, sells, unique_traders) at each milestone, by event-time timers: tokens without trades get theirs.

    ``events``: token, ts, trader, side ('launch', 'buy' or 'sell'; 'tick' moves time only).  Only a launch, the
    first one, starts a token's clock; trades that come before it wait.  After the last milestone a mark stays, so
    that later trades start nothing anew, until ``evict_ms`` after the launch (or after the first event of a token
    that never launched).  With ``due`` the event time of the milestone (ms) is given too.  This kind of state needs RocksDB, which is set for the session's new queries.
    """
    events.sparkSession.conf.set(_STORE, _ROCKSDB)
    side = F.col("side")
    kind = F.when(side == "tick", TICK).when(side == "buy", BUY).when(side == "sell", SELL).when(side == "launch", LAUNCH).otherwise(OTHER).cast("int")
    rows = events.withWatermark(time, delay).select("token", time, F.unix_millis(time).alias("ms"), F.coalesce("trader", F.lit(-1).cast("bigint")).alias("trader"), kind.alias("kind"))
    found = rows.groupBy("token").transformWithStateInPandas(Milestones(tuple(ages), evict_ms), OUTPUT, "append", "eventTime")
    return found if due else found.drop("due")
