"""Structured Streaming forms: span metrics, activity sessions, conversation state, idempotent appends.

The batch functions do the work; these add watermarks, de-duplication, state and
sinks.  Streams need timestamps with a time zone, so NTZ columns are cast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import telemetry as t
from ..operators.conversation import MOST_FACTS, fold_fact
from ..store import shared_dir

LATE = "10 minutes"


def metrics_stream(spans: DataFrame, paths, window: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """The measures of telemetry.window_measures by event-time window (tumbling, or sliding by
    slide), source and span.  Repeated span ids within the watermark count once; later rows
    are dropped by the watermark and counted (run_upserts)."""
    s = t.normalise_spans(spans.withColumn("started_at", F.col("started_at").cast("timestamp")))
    s = s.withWatermark("started_at", late).dropDuplicatesWithinWatermark(["span_id"])
    w = F.window("started_at", window, slide) if slide else F.window("started_at", window)
    g = s.groupBy(w.alias("w"), "source", "name").agg(*t.window_measures(paths))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *[c for c in g.columns if c != "w"])


def session_stream(spans: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Activity sessions of each session id, once the watermark has passed their end."""
    return t.span_sessions(spans.withColumn("started_at", F.col("started_at").cast("timestamp")).withWatermark("started_at", late), gap)


def turn_sessions(turns: DataFrame, idle: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Sessions of each conversation, once the watermark has passed their end: conv_id, start,
    stop, turns, first, last.  A turn that comes later than that starts another one."""
    t_ = turns.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    g = t_.groupBy("conv_id", F.session_window("at", idle).alias("w")).agg(F.count("*").alias("turns"), F.min("turn").alias("first"), F.max("turn").alias("last"))
    return g.select("conv_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "turns", "first", "last")


def append_once(path: str):
    """foreachBatch writer: a batch that is run again replaces its own rows only."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


_STATE = "slots map<string,string>, turns long, last_turn long"
_OUT = "conv_id long, turn long, substrate string, location string, turns long, expired boolean"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    slots, n, last = state.get if state.exists else ({}, 0, -1)
    slots = dict(slots)
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"conv_id": [key[0]], "turn": [last], "substrate": [slots.get("substrate")], "location": [slots.get("location")], "turns": [n], "expired": [True]})
        return
    rows = pd.concat(list(batches)).sort_values(["at", "turn"])
    out = []
    for r in rows.itertuples():
        for s in ("substrate", "location"):
            v = getattr(r, s)
            if isinstance(v, str):
                slots[s] = v
        n, last = n + 1, int(r.turn)
        out.append((key[0], last, slots.get("substrate"), slots.get("location"), n, False))
    state.update((slots, n, last))
    newest = int(rows["at"].max().timestamp() * 1000)
    state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs() + 1) + 30 * 60 * 1000)
    yield pd.DataFrame(out, columns=["conv_id", "turn", "substrate", "location", "turns", "expired"])


def conversation_state(turns: DataFrame, late: str = LATE) -> DataFrame:
    """Each turn with the slots carried so far, and a row when 30 idle minutes end a
    conversation and its state.  turns: conv_id, turn, at, substrate, location."""
    t_ = turns.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return t_.groupBy("conv_id").applyInPandasWithState(_fold, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


#: Facts of a turn, in their order.
TURN_FACTS = "array<struct<slot:string,value:string,provenance:string,keep:boolean>>"
_SLOT_OUT = "conv_id long, case_id long, slot string, value string, provenance string, turn long, status string, superseded array<string>, conflicting array<string>, touched long, expired boolean"
_SLOT_STATE = "value string, provenance string, turn long, status string, superseded array<string>, conflicting array<string>"
_RECENT = "ms long, turn long, nth long, value string, provenance string"


class SlotFold(StatefulProcessor):
    """What a slot of a case knows, as merge_facts has it, over a stream.

    The fold covers the facts up to the watermark; later ones wait in a list, as an earlier one
    can still arrive, and are put to the fold in their order for each output.  So the order of
    arrival makes no difference, and the list holds one slot's facts of the lateness only.  When
    no fact has come for the idle time, a last row is given and all state goes."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", _SLOT_STATE)
        self.recent = handle.getListState("recent", _RECENT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        done = timerValues.getCurrentWatermarkInMs()
        facts = [*(Row(*x) for x in self.recent.get()), *(Row(r.ms, r.turn, r.nth, r.value, r.provenance) for r in rows)]
        facts.sort(key=lambda x: (x[1], x[2]))
        state = self._state()
        settled = [x for x in facts if x[0] <= done]
        waiting = [x for x in facts if x[0] > done]
        for x in settled:
            state = fold_fact(state, {"turn": x[1], "value": x[3], "provenance": x[4]})
        if settled:
            self.folded.update(tuple(state.values()))
        self.recent.put([tuple(x) for x in waiting]) if waiting else self.recent.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        touched = max(x[0] for x in facts)
        self.handle.registerTimer(max(touched, done) + self.idle_ms)
        yield self._row(key, self._known(state, waiting), touched, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        waiting = sorted((Row(*x) for x in self.recent.get()), key=lambda x: (x[1], x[2]))
        state = self._known(self._state(), waiting)
        ended = expiredTimerInfo.getExpiryTimeInMs() - self.idle_ms
        self.folded.clear()
        self.recent.clear()
        yield self._row(key, state, ended, True)

    def close(self) -> None:
        pass

    def _state(self) -> dict | None:
        held = self.folded.get() if self.folded.exists() else None
        return dict(zip(("value", "provenance", "turn", "status"), held[:4])) | {"superseded": list(held[4]), "conflicting": list(held[5])} if held else None

    @staticmethod
    def _known(state: dict | None, waiting: list[Row]) -> dict:
        for x in waiting:
            state = fold_fact(state, {"turn": x[1], "value": x[3], "provenance": x[4]})
        return state

    @staticmethod
    def _row(key, state: dict, touched: int, expired: bool) -> Row:
        return Row(conv_id=key[0], case_id=key[1], slot=key[2], **state, touched=touched, expired=expired)


def session_facts(turns: DataFrame, late: str = LATE, idle: str = "30 minutes") -> DataFrame:
    """What every slot of a conversation's cases knows, live: a row for each slot that a batch
    touches, and one with expired = true when idle time ends it.  turns: conv_id, case_id, turn, at,
    opens (the turn opens a later case), facts (TURN_FACTS, in their order).

    A slot of a case is a group, so a hot conversation is spread over its slots and cases; a task
    holds the facts of one of them that came in one batch or within the lateness."""
    spark = turns.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    idle_ms = int(spark.range(1).select(F.expr(f"unix_millis(timestamp_seconds(0) + interval {idle})")).first()[0])
    kept = F.when(F.col("opens"), F.filter("facts", lambda x: F.coalesce(x["keep"], x["provenance"] != "carried"))).otherwise(F.col("facts"))
    f = turns.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    f = f.select("conv_id", "case_id", "turn", "at", F.posexplode(F.slice(kept, 1, MOST_FACTS)).alias("nth", "x"))
    f = f.select("conv_id", "case_id", "x.slot", "at", F.unix_millis("at").alias("ms"), F.col("turn").cast("long").alias("turn"), F.col("nth").cast("long").alias("nth"), "x.value", "x.provenance").where("value is not null or provenance = 'denied'")
    out = f.groupBy("conv_id", "case_id", "slot").transformWithState(statefulProcessor=SlotFold(idle_ms), outputStructType=_SLOT_OUT, outputMode="Update", timeMode="EventTime")
    return out.withColumn("touched", F.timestamp_millis("touched"))


class Upserts:
    """A keyed table that a stream writes: a batch adds its rows as a whole, a batch that is run
    again replaces its own only, and of the rows of a key the one of the latest batch counts."""

    def __init__(self, path: str, keys: list[str], schema):
        self.path, self.keys, self.schema = path, keys, schema

    def write(self, df: DataFrame, batch: int) -> None:
        append_once(self.path)(df, batch)

    def read(self, spark) -> DataFrame:
        if not _exists(spark, self.path):
            return spark.createDataFrame([], self.schema)
        rows = spark.read.schema(T.StructType([*self.schema, T.StructField("batch", T.LongType())])).option("basePath", self.path).parquet(self.path)
        row = F.struct(*self.schema.fieldNames())
        # Rows of a key that a batch both updates and ends: the end counts.
        last = rows.groupBy(*self.keys).agg(F.max_by(row, F.struct("batch", "expired")).alias("row")) if "expired" in self.schema.fieldNames() else rows.groupBy(*self.keys).agg(F.max_by(row, "batch").alias("row"))
        return last.select("row.*")

    def compact(self, spark, path: str) -> Upserts:
        """The same table with one row a key, in another folder, as its batch -1."""
        self.read(spark).write.mode("overwrite").parquet(f"{path}/batch=-1")
        return Upserts(path, self.keys, self.schema)


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def run_upserts(stream: DataFrame, keys: list[str], path: str) -> Upserts:
    """Run a stream over what its source has now, into the keyed table path/rows; run again
    with the same path, it goes on from there.  late_rows of the table: how many rows this run
    dropped as later than the watermark."""
    table = Upserts(f"{path}/rows", keys, stream.schema)
    q = stream.writeStream.outputMode("update").foreachBatch(table.write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    table.late_rows = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    return table


def session_rows(folded: DataFrame) -> DataFrame:
    """The session row of each conversation: conv_id, cases, slots (of the last case, that are
    settled), touched, expired."""
    last = folded.withColumn("last", F.max("case_id").over(W.partitionBy("conv_id")))
    g = last.groupBy("conv_id").agg(F.count_distinct("case_id").alias("cases"), F.count_if((F.col("case_id") == F.col("last")) & (F.col("status") == "active")).alias("slots"), F.max("touched").alias("touched"), F.bool_and("expired").alias("expired"))
    return g.select("conv_id", "cases", "slots", "touched", "expired")


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run an appending stream over what its source has now and return the result table.
    Rows go to the shared folder batch by batch and are read back."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/rows/batch=-1")  # a source may have nothing
    q = stream.writeStream.outputMode("append").foreachBatch(append_once(f"{path}/rows")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(stream.columns)


def with_span_defaults(spans: DataFrame, now=None) -> DataFrame:
    """Spans as they are stored: status ok, source unknown and the time now where they are missing."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    blank = lambda c, default: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(default)).otherwise(F.col(c))
    return spans.withColumns({"status": blank("status", "ok"), "source": blank("source", "unknown"), "started_at": F.coalesce(F.col("started_at").cast("timestamp"), at)})


def append_spans(path: str, now=None):
    """foreachBatch writer of spans: defaults first, and a batch is there as a whole or not at all."""
    write = append_once(path)
    return lambda df, batch: write(with_span_defaults(df, now), batch)
