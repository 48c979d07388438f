"""Sessions split at gaps over a stream whose events come in any order.

A session's number is the count of gaps before it, so an event that comes late can join two sessions, or open one before
them, and changes the numbers of later events. Each change is a row of its own with a higher `revision`; the last one counts
(`latest`). With a watermark, events behind it are final: only the last of them and its number are kept."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.threads import GAP_DAYS

DAY = 86_400_000_000
BUCKETS = 1024  # of keys; what one holds is read and written whole
EVENT, UNTOLD = ["key", "at_us", "id", "no_id"], -1
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def numbered(events: list[tuple], base: tuple | None, days: int) -> list[int]:
    """The session of each event (time, id), in order, after a base (time, session)."""
    last, number = base or (None, 0)
    out = []
    for at, _ in events:
        number += last is not None and (at - last) // DAY > days
        out.append(number)
        last = at
    return out


class GapSessions(StatefulProcessor):
    """State of a bucket of keys, one Arrow table: the events that aren't final yet with the number that was last told, and
    before them each key's last final event. All keys of a bucket are numbered at once."""

    def __init__(self, days: int) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getValueState("events", "rows binary")
        self.revision = handle.getValueState("revision", "n long")

    def _known(self) -> list[pd.DataFrame]:
        return [pa.ipc.open_stream(self.events.get()[0]).read_pandas()] if self.events.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        come = pd.concat([frame[EVENT] for frame in rows], ignore_index=True).assign(session=UNTOLD, final=False)
        events = pd.concat([*self._known(), come], ignore_index=True).drop_duplicates(EVENT)
        events = events.assign(_open=~events["final"]).sort_values(["key", "_open", "at_us", "id"], ignore_index=True).drop(columns="_open")
        at, told = events["at_us"].to_numpy(), events["session"].to_numpy()
        start = np.r_[True, events["key"].to_numpy()[1:] != events["key"].to_numpy()[:-1]]
        gaps = np.cumsum(~start & (np.diff(at, prepend=at[0]) // DAY > self.days))
        base = np.where(events["final"].to_numpy()[start], told[start], 0) - gaps[start]
        events["session"] = gaps + base[np.cumsum(start) - 1]
        self._keep(events, timerValues)
        changed = events[told != events["session"]]
        if len(changed):
            revision = (self.revision.get()[0] if self.revision.exists() else 0) + 1
            self.revision.update((revision,))
            yield changed[[*EVENT, "session"]].assign(revision=revision)

    def _keep(self, events: pd.DataFrame, timers: Any) -> None:
        """Of what is behind the watermark, each key's last event is the base; a timer comes back for the rest."""
        behind = timers.getCurrentWatermarkInMs() * 1000
        done = events["at_us"] < behind
        left = events[~done]
        kept = pd.concat([events[done].drop_duplicates("key", keep="last").assign(final=True), left]) if done.any() else left
        with pa.BufferOutputStream() as out:
            table = pa.Table.from_pandas(kept, preserve_index=False)
            with pa.ipc.new_stream(out, table.schema) as writer:
                writer.write_table(table)
            self.events.update((out.getvalue().to_pybytes(),))
        if behind >= 0 and len(left):
            self.handle.registerTimer(int(left["at_us"].max()) // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for events in self._known():
            self._keep(events, timerValues)
        return iter([])

    def close(self) -> None:
        pass


def gap_sessions(events: DataFrame, key: str, at: str, id: str, days: int = GAP_DAYS, late: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """key, id, at, session, revision of a stream's events, to be written in update mode with ROCKS configured. Events of one
    time are told apart by `id`; an event that comes again changes nothing. Without a key or a time an event has no session.
    `late` bounds the state: events that come later than that are dropped, as every stream with a watermark does. Keys are
    dealt to `buckets`, whose number has to stay the same for one checkpoint."""
    kinds = dict(events.dtypes)
    typed = events.select(F.col(key).alias("key"), F.coalesce(F.col(id), F.lit("0").try_cast(kinds[id])).alias("id"), F.col(id).isNull().alias("no_id"), F.col(at).cast("timestamp").alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"))
    fits = F.col("key").isNotNull() & F.col("at").isNotNull()
    some = typed.where(fits).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    some = (some if late is None else some.withWatermark("at", late)).groupBy("bucket")
    out = f"key {kinds[key]}, at_us long, id {kinds[id]}, no_id boolean, session long, revision long"
    found = some.transformWithStateInPandas(GapSessions(days), out, "Update", "None" if late is None else "EventTime")
    found = found.select(F.col("key").alias(key), F.when(~F.col("no_id"), F.col("id")).alias(id), F.timestamp_micros("at_us").alias(at), "session", "revision")
    none = typed.where(~fits).select(F.col("key").alias(key), F.when(~F.col("no_id"), F.col("id")).alias(id), F.col("at").alias(at), F.lit(None).cast("long").alias("session"), F.lit(0).cast("long").alias("revision"))
    return found.unionByName(none)


def latest(told: DataFrame, *event: str) -> DataFrame:
    """The last session that was told of each event."""
    return told.groupBy(*event).agg(F.max_by("session", "revision").alias("session"))
