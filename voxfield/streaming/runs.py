"""The event log of runs as keyed state: events get numbers, end with the terminal one and are forgotten after a while; batches go to several sinks, each once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType


def _keep(state: GroupState, value: tuple, last: pd.Timestamp, ttl_ms: int) -> None:
    state.update(value)
    if ttl_ms:
        state.setTimeoutTimestamp(max(last.value // 1_000_000, state.getCurrentWatermarkMs()) + ttl_ms)


def _timeout(events: DataFrame, at: str, ttl_ms: int) -> tuple[DataFrame, str]:
    """State expires by event time: the watermark, which follows `at` without delay beyond ttl_ms, ends a run that was silent for so long. (Timeouts by processing time would
    never let a stream over what there is come to its end.)"""
    if not ttl_ms:
        return events, GroupStateTimeout.NoTimeout
    return events.withWatermark(at, f"{ttl_ms} milliseconds"), GroupStateTimeout.EventTimeTimeout


def numbered(events: DataFrame, run: str, order: list[str], kind: str, terminal: list[str], ttl_ms: int = 0) -> DataFrame:
    """events with `seq`: 1, 2, ... within each run, over all batches. The first event whose kind is terminal closes its run; what comes after is ignored.
    A run's events of one batch are put in order first (order[0] is their time), as exchanges keep none. ttl_ms: a run that is silent for so long is forgotten, closed ones too; 0 keeps all."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        number, closed = state.get if state.exists else (1, False)
        events_ = pd.concat(list(frames))
        last = events_[order[0]].max()
        if not closed:
            events_ = events_.sort_values(order)
            ends = events_[kind].isin(terminal).to_numpy()
            kept = events_.iloc[: ends.argmax() + 1] if ends.any() else events_
            yield kept.assign(seq=range(number, number + len(kept)))
            number, closed = number + len(kept), bool(ends.any())
        _keep(state, (number, closed), last, ttl_ms)

    out = StructType([*events.schema.fields, StructField("seq", LongType())])
    watched, timeout = _timeout(events, order[0], ttl_ms)
    return watched.groupBy(run).applyInPandasWithState(step, out, "next bigint, closed boolean", "append", timeout)


def latest_stage(events: DataFrame, run: str, at: str, number: str, kind: str, terminal: list[str], ttl_ms: int = 30 * 86_400_000) -> DataFrame:
    """For update mode: (run, last_type, done) of each run that a batch touches: its last event by time and number, and whether a terminal one came. A run's state goes after
    ttl_ms of silence (0: never), so state follows the live runs, not all there ever were."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, done = None, False
        if state.exists:
            micros, n, what, done = state.get
            last = (micros, n, what)
        for f in frames:
            row = f.sort_values([at, number]).iloc[-1]
            found = (pd.Timestamp(row[at]).value // 1000, int(row[number]), row[kind])
            last = found if last is None or found[:2] >= last[:2] else last
            done = done or bool(f[kind].isin(terminal).any())
        _keep(state, (*last, done), pd.Timestamp(last[0] * 1000), ttl_ms)
        yield pd.DataFrame({run: [key[0]], "last_type": [last[2]], "done": [done]})

    out = StructType([events.schema[run], StructField("last_type", StringType()), StructField("done", BooleanType())])
    watched, timeout = _timeout(events, at, ttl_ms)
    return watched.groupBy(run).applyInPandasWithState(step, out, "at bigint, number bigint, kind string, done boolean", "update", timeout)


Sink = Callable[[DataFrame, int], None]


def parquet_sink(path: str) -> Sink:
    """Each batch in a folder of its own number: a batch that comes again replaces itself. Readers see whole batches only."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/_batch={number}")


def json_sink(path: str) -> Sink:
    return lambda batch, number: batch.write.mode("overwrite").json(f"{path}/_batch={number}")


def fan_out(stream: DataFrame, sinks: list[Sink], checkpoint: str, mode: str = "append") -> None:
    """Runs the stream over what there is and hands each batch, computed once, to all sinks in turn. If one fails the batch isn't committed: the next start with this checkpoint gives the same
    rows under the same number to all sinks again, and sinks that keep a batch by its number hold it once."""

    def put(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, number)
        finally:
            held.unpersist()

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
