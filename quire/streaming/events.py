"""Answer event streams: meta, tokens in order, done."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.functions.text import strip

PATIENCE = "1 hour"
STATE_KEY = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def assemble_events(events: DataFrame) -> DataFrame:
    """Batch form: events(answer_id, seq, type, text) to one row per answer.

    The answer is the concatenated tokens, trimmed; `done` says whether its last event was seen.
    """
    token = F.when(F.col("type") == "token", F.struct("seq", "text"))
    ordered = F.array_sort(F.collect_list(token))
    return events.groupBy("answer_id").agg(
        strip(F.array_join(F.transform(ordered, lambda t: t["text"]), "")).alias("answer"),
        F.count(token).alias("n_tokens"),
        F.coalesce(F.bool_or(F.col("type") == "done"), F.lit(False)).alias("done"),
    )


@contextmanager
def listed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that lists and timers need; a stream takes
    the settings along when it starts, and the session gets its own back."""
    before = spark.conf.get(STATE_KEY, None)
    spark.conf.set(STATE_KEY, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.unset(STATE_KEY) if before is None else spark.conf.set(STATE_KEY, before)


class Assembler(StatefulProcessor):
    """An answer's events are a list to which each batch only appends. `progress` says how many are held,
    the number of the done event (-1: not seen) and when the answer is given up; of an answer that has
    been emitted it keeps nothing but that time, so that events sent again are known and ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "seq bigint, kind string, text string")
        self.progress = handle.getValueState("progress", "held bigint, last bigint, expiry bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held, last, expiry = self.progress.get() if self.progress.exists() else (0, -1, -1)
        new = pd.concat(list(rows), ignore_index=True)
        until = max(expiry, int(new["ms"].max()) + 1)
        if until != expiry:
            if expiry >= 0:
                self.handle.deleteTimer(expiry)
            self.handle.registerTimer(until)
        if held < 0:
            self.progress.update((held, last, until))
            return
        fresh = [(int(s), k, t or "") for s, k, t in zip(new["seq"], new["type"], new["text"])]
        last = max([last, *(s for s, k, _ in fresh if k == "done")])
        self.events.appendList(fresh)
        held += len(fresh)
        if last >= 0 and held > last:  # enough to be complete, unless some were sent twice
            seen: dict[int, tuple[str, str]] = {}
            for seq, kind, text in self.events.get():
                seen.setdefault(int(seq), (kind, text))
            if len(seen) > last:
                tokens = [text for _, (kind, text) in sorted(seen.items()) if kind == "token"]
                self.events.clear()
                held = -1
                yield pd.DataFrame({"answer_id": [key[0]], "answer": ["".join(tokens).strip()], "n_tokens": [len(tokens)]})
            elif len(seen) < held:
                self.events.put([(s, k, t) for s, (k, t) in seen.items()])
                held = len(seen)
        self.progress.update((held, last, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.events.clear()
        self.progress.clear()
        return iter([])

    def close(self) -> None:
        pass


def assemble_stream(events: DataFrame, patience: str = PATIENCE, at: str | None = None) -> DataFrame:
    """Streaming form: an answer is emitted when its done event arrives and its events are complete.

    Events may arrive out of order. The done event's seq says how many events there are; of events with
    one seq the first counts, and events without answer_id or seq are ignored. `at` names a column of event
    times; without it an event's time is that of the batch it arrives in. An answer without an event for `patience`, as told by the watermark over all
    answers, is given up, and so is the memory that an answer was emitted; events later than that are
    dropped. Start the stream inside `listed_state`.
    """
    kind = events.schema["answer_id"].dataType.simpleString()
    timed = events.filter("answer_id is not null and seq is not null").withColumn("_at", F.current_timestamp() if at is None else F.col(at)).withWatermark("_at", patience)
    slim = timed.select("answer_id", "seq", "type", "text", "_at", F.unix_millis("_at").alias("ms"))
    return slim.groupBy("answer_id").transformWithStateInPandas(Assembler(), f"answer_id {kind}, answer string, n_tokens bigint", "Append", "EventTime")
